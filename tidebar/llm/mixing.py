"""Mixing sources to target weights by the cube method of balanced sampling.

A source's share comes from its weight, with a ceiling of `most` times its size and the excess reshared by weight. Every
document of a source is then due `rate` = target / source size times: the whole part is taken as it is, and the fraction
is an inclusion probability. The flight moves the probabilities of three documents at a time along the null space of the
two constraints (documents and words), until one of them is 0 or 1; so both totals stay as they are while documents
settle. Chunks of bounded size fly on their own, what is left of them (two at most) flies with that of other chunks, and
in the end two documents a source land: they are taken in part, by as many of their words as their probabilities say.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import cut, drop, small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
CHUNK = 2_000
FAN_IN = 500
SEED = 42
EPS = 1e-9


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: source, source_size (a row a source). Adds target: share of the total by weight, the weights repeating over
    the sources in order of code point (null last), no target above most * source_size."""
    whole = Window.partitionBy()
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("total", F.sum("source_size").over(whole).cast("double") * share)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    w = w.withColumn("level", (F.col("total") - before) / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    first = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("cap") / F.col("weight"))).over(whole)
    level = F.min_by("level", F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("cap") / F.col("weight"))).over(whole)
    return w.select("source", "source_size", F.when(first.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight"))).alias("target"))


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all but two at most are 0 or 1; sum(p) and sum(p * size) are kept."""
    p = p.astype(float).tolist()
    size = size.astype(float).tolist()
    for i, x in enumerate(p):
        if x < EPS or x > 1 - EPS:
            p[i] = round(x)
    waiting = iter([i for i, x in enumerate(p) if 0 < x < 1])
    held = list(itertools.islice(waiting, 3))
    coins = iter(rng.random(len(p) + 3).tolist())
    while len(held) == 3:
        a, b, c = held
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(held, u) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(held, u) if d)
        move = up if next(coins) * (up + down) < down else -down
        still = []
        for i, d in zip(held, u):
            x = p[i] + move * d
            p[i] = x = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x
            if 0 < x < 1:
                still.append(i)
        if len(still) == 3:  # only rounding can leave all three
            i = min(still, key=lambda i: min(p[i], 1 - p[i]))
            p[i] = float(round(p[i]))
            still.remove(i)
        held = still + list(itertools.islice(waiting, 3 - len(still)))
    return np.array(p)


def _level(seed: int):
    def run(key, table):
        order = np.lexsort((table.column("size").to_numpy(), table.column("doc_id").fill_null(-1).to_numpy(), table.column("mixed_by").to_numpy()))
        table = table.take(pa.array(order))
        size, p = table.column("size").to_numpy(), table.column("p").to_numpy()
        name = repr((seed, *[k.as_py() for k in key])).encode()
        p = flight(size, p, np.random.default_rng(int.from_bytes(hashlib.sha256(name).digest()[:8], "little")))
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return run


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, chunk: int = CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document how much of it the mix takes: doc_id, size, source_size, target, taken (words), copies (whole ones, rounded).

    documents: doc_id, source, text; extra columns are ignored. A null text has size 0; null sources are one source, the
    last; repeated rows are documents of their own; an empty table gives no rows; a source without words has target 0
    and its documents 0 copies. `keep` names columns to carry along, as keep_<name>. Reruns agree: coins and order come from hashes."""
    extra = [F.col(c).alias(f"keep_{c}") for c in keep]
    docs = cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"), *extra), "sizes")
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    share_of = cut(targets(sources.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "s"), "targets")
    counts = sources.select(F.col("source").alias("s"), "n")
    table = cut(share_of.join(counts, share_of.s.eqNullSafe(counts.s)).select(share_of.s, "source_size", "target", "n"), "shares")
    named = small(table, table.count(), 64)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = docs.join(named, docs.source.eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    rows = rows.withColumn("whole", F.floor(F.col("rate") + EPS)).withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("mixed_by", F.xxhash64(F.lit(seed), "doc_id", "size"))
    chunks = max(1, math.ceil((table.agg(F.max("n")).first()[0] or 0) / chunk))
    rows = rows.withColumn("chunk", F.pmod(F.col("mixed_by"), F.greatest(F.ceil(F.col("n") / chunk), F.lit(1))).cast("long"))
    settled = []
    while True:
        last = chunks == 1
        rows = cut(rows.groupBy("source", "chunk").applyInArrow(_level(seed), rows.schema), "flight")
        if last:
            break
        fixed = (F.col("p") == 0) | (F.col("p") == 1)
        settled.append(rows.where(fixed))
        rows = rows.where(~fixed).withColumn("chunk", F.floor(F.col("chunk") / FAN_IN).cast("long"))
        chunks = math.ceil(chunks / FAN_IN)
    for x in settled:
        rows = rows.unionByName(x)
    taken = F.col("whole") * F.col("size") + F.round(F.col("p") * F.col("size")).cast("long")
    copies = (F.col("whole") + F.round("p")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"), *[F.col(f"keep_{c}") for c in keep])
