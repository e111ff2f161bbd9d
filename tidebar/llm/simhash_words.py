"""Near-duplicate texts by similarity: rare shingles propose, exact shingle sets decide, none of the similar pairs is left out.

Texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. In any order of all
shingles, two such sets share one among the first fifth (and one) of each: its prefix. The order puts shingles that recur
in a sample last, so that few texts meet in an entry, and those of similar size only are compared. First each text is
compared with its neighbours in the entries, then every pair of an entry that the links found don't already connect: a
bound on the sets' difference (parities of their hashes) leaves out those that can't be similar, the sets decide on the
rest. Entries of many texts are compared in tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import simhash
from tidebar.llm.common import cut, keyed, lean, settle, short_batches, small, text_name, texts

SHINGLE = 5
SIMILARITY = 0.8
TILE = 2048
#: Longs of parities that stand for a set.
PARITIES = 8
#: Texts in the sample that orders the shingles, and shingles that are put last.
SAMPLE = 40_000
FREQUENT = 200_000
#: Parts (a power of two) in which the sample's shingles are counted, and shingles that a task holds before it parts them.
PARTS = 256
HELD = 500_000
#: Orders of an entry's texts in which neighbours are compared first.
ORDERS = 4

MEMBER = "key long, tid long, n int, root long, parity array<long>"


def shingle_set(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    words = data.split()
    joined = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    return np.unique(np.array([xxhash.xxh3_64_intdigest(x) for x in joined], np.uint64))


def parities(s: np.ndarray) -> np.ndarray:
    """A bit for each shingle at least (a power of two of them): two sets differ in as many bits as their difference has
    elements, or in fewer. Parities of different lengths are compared by folding the longer one."""
    size = 64 * PARITIES
    while size < len(s):
        size *= 2
    bits = (np.bincount((s % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def folded(parity: np.ndarray, longs: int = PARITIES) -> np.ndarray:
    return np.bitwise_xor.reduce(parity.reshape(-1, longs), axis=0)


def prefix(s: np.ndarray, similarity: float, frequent: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles of which a similar set has one in its own prefix, the rarest first. frequent: shingles in order; often: their counts."""
    if not len(s):
        return s
    count = np.zeros(len(s), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        count = np.where(frequent[at] == s, often[at], 0)
    return s[np.lexsort((s, count))[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate(([0], np.cumsum([len(v) for v in values])))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)))


def _runs(shingle: int, held_most: int = HELD):
    """The texts' shingles in sorted runs, a row for each part: as rows of their own they would fill the executor's heap."""
    edges = np.arange(1, PARTS, dtype=np.uint64) * np.uint64(2**64 // PARTS)

    def rows(held):
        s = np.sort(np.concatenate(held))
        ends = np.concatenate(([0], np.searchsorted(s, edges), [len(s)])).astype(np.int32)
        part = np.flatnonzero(np.diff(ends))
        bounds = np.append(ends[part], ends[-1]) * np.int32(8)
        run = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(bounds), pa.py_buffer(s)])
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), run], names=["part", "run"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for text in batch.column("text"):
                held.append(shingle_set(text.as_buffer().to_pybytes(), shingle))
                n += len(held[-1])
                if n >= held_most:
                    yield rows(held)
                    held, n = [], 0
        if n:
            yield rows(held)

    return run


def _recurrent(batches):
    """Of runs in order of part: the shingles that come more than once, and how often."""

    def count(runs):
        s, n = np.unique(np.concatenate(runs), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(s[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["s", "n"])

    held, at = [], None
    for batch in batches:
        for part, run in zip(batch.column("part").to_pylist(), batch.column("run")):
            if part != at and held:
                yield count(held)
                held = []
            at = part
            held.append(np.frombuffer(run.as_buffer(), np.uint64))
    if held:
        yield count(held)


def _prefixes(shingle: int, similarity: float, frequent: np.ndarray, often: np.ndarray):
    """A row for each shingle of a text's prefix; a text that comes again in the same task is left out."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            tid, keys = [], []
            for t, text in zip(batch.column("tid").to_pylist(), batch.column("text")):
                if t not in seen:
                    seen.add(t)
                    keys.append(prefix(shingle_set(text.as_buffer().to_pybytes(), shingle), similarity, frequent, often))
                    tid.append(t)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(tid, np.int64), [len(k) for k in keys]))], names=["key", "tid"])

    return run


def _recurring(batches):
    """Of rows in order of key, those whose key has several texts, once each, with the text before under that key (null: the first)."""
    held, kept, before = [np.zeros(0, np.int64)] * 2, False, None
    rows = lambda key, tid, near: pa.RecordBatch.from_arrays([pa.array(key), pa.array(tid), pa.array(near[0], mask=~near[1])], names=["key", "tid", "near"])
    for batch in batches:
        key, tid = (np.concatenate(x) for x in zip(held, (batch.column("key").to_numpy(), batch.column("tid").to_numpy())))
        if not len(key):
            continue
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (tid[1:] != tid[:-1])
        key, tid = key[fresh], tid[fresh]
        same = np.concatenate(([kept and before is not None], key[1:] == key[:-1]))
        near = np.concatenate(([before or 0], tid[:-1]))
        keep = same.copy()
        keep[:-1] |= same[1:]
        keep[-1] = False  # held
        yield rows(key[keep], tid[keep], (near[keep], same[keep]))
        kept, before = bool(same[-1]), int(near[-1]) if same[-1] else None
        held = [key[-1:], tid[-1:]]
    if kept:
        yield rows(*held, (np.array([before], np.int64), np.ones(1, bool)))


def unlinked(key: np.ndarray, tid: np.ndarray, n: np.ndarray, root: np.ndarray, parity: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b), a < b, with one key (rows are in order of key) and different roots that may be similar."""
    out, i = [np.zeros((2, 0), np.int64)], np.arange(len(key))
    for step in range(1, len(key)):
        i = i[: np.searchsorted(i, len(key) - step)]
        i = i[key[i] == key[i + step]]
        if not len(i):
            break
        x = i[root[i] != root[i + step]]
        y = x + step
        fit = np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9
        x, y = x[fit], y[fit]
        apart = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64)
        fit = apart <= (n[x].astype(np.int64) + n[y]) * (1 - similarity) / (1 + similarity) + 1e-9
        x, y = tid[x[fit]], tid[y[fit]]
        out.append(np.stack((np.minimum(x, y), np.maximum(x, y))))
    a, b = np.unique(np.concatenate(out, axis=1), axis=1)
    return a, b


def _columns(batch) -> list[np.ndarray]:
    parity = batch.column("parity")
    parity = parity.combine_chunks() if isinstance(parity, pa.ChunkedArray) else parity
    return [*(batch.column(c).to_numpy() for c in ("key", "tid", "n", "root")), parity.flatten().to_numpy().view(np.uint64).reshape(-1, PARITIES)]


def _compare(similarity: float, tile: int):
    none = lambda n, t=pa.int64(): pa.nulls(n, t)
    names = ["a", "b", "key", "tid", "n", "root", "parity"]

    def late(rows):
        m = len(rows[0])
        return pa.RecordBatch.from_arrays([none(m), none(m), *(pa.array(x) for x in rows[:4]), _lists(list(rows[4]))], names=names)

    def solve(rows):
        key = rows[0]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        mixed = np.minimum.reduceat(rows[3], start) != np.maximum.reduceat(rows[3], start)
        now = np.repeat(mixed & (size <= tile), size)
        a, b = unlinked(*[x[now] for x in rows], similarity)
        m = len(a)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none(m), none(m), none(m, pa.int32()), none(m), none(m, pa.list_(pa.int64()))], names=names)
        then = np.repeat(size > tile, size)  # part of such an entry may have been passed on, with other roots
        if then.any():
            yield late([x[then] for x in rows])

    def run(batches):
        held = None
        for batch in batches:
            new = _columns(batch)
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            key = held[0]
            if len(key) and key[0] == key[-1] and len(key) > 4 * tile:  # one entry fills what is held: pass it on, but for a tile that keeps it large
                m = len(key) - tile - 1
                yield late([x[:m] for x in held])
                held = [x[m:] for x in held]
                continue
            whole = np.searchsorted(key, key[-1]) if len(key) else 0
            if whole:
                yield from solve([x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if held is not None and len(held[0]):
            yield from solve(held)

    return run


def _tiles(similarity: float):
    def run(key, table):
        a, b = unlinked(*_columns(table), similarity)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def unlinked_pairs(members: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(a, b), a < b: all pairs of texts with a common key and different roots that may be similar. members: key, tid, n, root, parity."""
    filed = members.select("key", "tid", "n", "root", "parity").repartition("key").sortWithinPartitions("key")
    found = cut(filed.mapInArrow(lean(_compare(similarity, tile)), f"a long, b long, {MEMBER}"), "compared")
    out = found.where("key is null").select("a", "b")
    late = found.where("key is not null").drop("a", "b")
    sizes = late.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "m")
    if sizes.agg(F.max("m")).first()[0]:
        dealt = late.join(sizes, "key").withColumn("t", F.ceil(F.col("m") / tile)).withColumn("own", F.pmod(F.xxhash64("tid"), F.col("t")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1)))
        dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "tid", "n", "root", "parity")
        out = out.union(dealt.groupBy("key", "i", "j").applyInArrow(_tiles(similarity), "a long, b long"))
    return out.distinct()


def _first(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """tid and text of the texts in `asked` (tid, first: the least id), as a rule one row each."""
    asked = cut(asked.select(F.col("tid").alias("t"), "first"), "asked")
    return docs.join(small(asked, asked.count()), (F.col("tid") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").select("tid", "text")


def _frequent(docs: DataFrame, nodes: DataFrame, n_texts: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample of the texts, in order, and in how many of its texts. They only order the shingles."""
    sample = _first(docs, nodes.where(F.pmod("tid", F.lit(max(1, n_texts // SAMPLE))) == 0))
    runs = sample.mapInArrow(lean(_runs(shingle)), "part int, run binary").repartition("part").sortWithinPartitions("part")
    with short_batches(docs.sparkSession):
        counts = runs.mapInArrow(lean(_recurrent), "s long, n long").orderBy(F.col("n").desc(), "s").limit(FREQUENT).toArrow()
    s, n = counts.column("s").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _bounded(similarity: float):
    """Pairs (a, m, x; b, n, y) whose parities leave it open that they are similar."""

    def run(batches):
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            most = (batch.column("m").to_numpy().astype(float) + batch.column("n").to_numpy()) * (1 - similarity) / (1 + similarity) + 1e-9
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = xs[i].values.to_numpy().view(np.uint64), ys[i].values.to_numpy().view(np.uint64)  # set bits of negative numbers count otherwise
                longs = min(len(x), len(y))
                keep[i] = np.bitwise_count(folded(x, longs) ^ folded(y, longs)).sum() <= most[i]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run


def _equal_enough(similarity: float, shingle: int):
    """Pairs (a, b, x, y: their texts) whose shingle sets are similar."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                p, q = (shingle_set(t.as_buffer().to_pybytes(), shingle) for t in (x, y))
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep[i] = shared >= similarity * (len(p) + len(q) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run


def _alike(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Parities part most that aren't; the texts of the rest meet."""
    wide = lambda side, n, x: nodes.select(F.col("tid").alias(side), F.col("n").alias(n), F.col("wide").alias(x))
    near = pairs.join(wide("a", "m", "x"), "a").join(wide("b", "n", "y"), "b").mapInArrow(lean(_bounded(similarity)), "a long, b long")
    with short_batches(docs.sparkSession):
        near = cut(near, "near")
    one = _first(docs, nodes.join(near.select(F.col("a").alias("tid")).union(near.select("b")).distinct(), "tid", "left_semi"))
    both = near.join(one.select(F.col("tid").alias("a"), F.col("text").alias("x")), "a").join(one.select(F.col("tid").alias("b"), F.col("text").alias("y")), "b")
    with short_batches(docs.sparkSession):
        return cut(both.mapInArrow(lean(_equal_enough(similarity, shingle)), "a long, b long").distinct(), "alike")


def _scan(shingle: int):
    def run(batches):
        for batch in batches:
            fp = np.array([simhash.fingerprint(t.as_buffer().to_pybytes()) for t in batch.column("text")], np.uint64)
            sizes, wide = [], []  # not the sets themselves
            for t in batch.column("text"):
                s = shingle_set(t.as_buffer().to_pybytes(), shingle)
                sizes.append(len(s))
                wide.append(parities(s))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "tid", "name")), pa.array(fp.view(np.int64)), pa.array(sizes, pa.int32()), _lists(wide)], names=["doc_id", "tid", "name", "fp", "n", "wide"])

    return run


def similar_groups(documents: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """Per document: doc_id, tid (key of its text), name (128 bits of its SHA-256, in hex), component_id: the least doc_id reachable over links, root: the least tid of them.

    Texts are linked if their shingle sets are similar, or if their SimHash fingerprints differ in three bits at most (as
    near_duplicates has it). documents: doc_id, text (extra columns are ignored). Equal texts are one; null texts are
    empty; texts without words are linked with each other; an empty table gives no rows."""
    docs = keyed(texts(documents))
    scan = docs.withColumn("name", text_name(F.col("text"))).mapInArrow(lean(_scan(shingle)), "doc_id long, tid long, name string, fp long, n int, wide array<long>")
    with short_batches(docs.sparkSession):
        scan = cut(scan, "fingerprints")
    nodes = cut(scan.groupBy("tid").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("wide").alias("wide")), "texts")
    fps = cut(nodes.groupBy("fp").agg(F.min("tid").alias("tid")), "distinct")
    roots = simhash.components(simhash.links(fps.select("fp")))
    strict = fps.join(roots, fps.fp == roots.node).join(fps.select(F.col("fp").alias("root"), F.col("tid").alias("b")), "root").select(F.col("tid").alias("a"), "b")
    same = nodes.select("tid", "fp").join(fps.select("fp", F.col("tid").alias("b")), "fp").where("tid <> b").select(F.col("tid").alias("a"), "b")

    filed = docs.mapInArrow(lean(_prefixes(shingle, similarity, *_frequent(docs, nodes, nodes.count(), shingle))), "key long, tid long")
    filed = filed.repartition("key").sortWithinPartitions("key", F.xxhash64("tid", F.pmod("key", F.lit(ORDERS))), "tid")
    with short_batches(docs.sparkSession):
        recurring = cut(filed.mapInArrow(lean(_recurring), "key long, tid long, near long"), "recurring")
    settle(docs.sparkSession)
    small_parity = F.transform(F.sequence(F.lit(0), F.lit(PARITIES - 1)), lambda i: F.aggregate(F.filter("wide", lambda _, j: j % PARITIES == i), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)))
    info = cut(nodes.join(recurring.select("tid").distinct(), "tid", "left_semi").select("tid", "n", small_parity.alias("parity")), "sizes")
    near = recurring.where("near is not null").select(F.least("tid", "near").alias("a"), F.greatest("tid", "near").alias("b")).distinct()
    near = near.join(info.select(F.col("tid").alias("a"), F.col("n").alias("m"), F.col("parity").alias("x")), "a").join(info.select(F.col("tid").alias("b"), "n", F.col("parity").alias("y")), "b")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, c: a + c)
    near = near.where((F.least("m", "n") >= similarity * F.greatest("m", "n") - 1e-9) & (apart <= (F.col("m") + F.col("n")) * ((1 - similarity) / (1 + similarity)) + 1e-9))
    alike = _alike(docs, nodes, cut(near.select("a", "b"), "neighbours"), similarity, shingle)
    root = simhash.components(alike.union(strict).union(same))

    members = recurring.select("key", "tid").join(info.join(root, info.tid == root.node, "left").select("tid", "n", F.coalesce("root", "tid").alias("root"), "parity"), "tid")
    rest = cut(unlinked_pairs(members, similarity, tile), "unlinked")
    root = simhash.components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_alike(docs, nodes, rest, similarity, shingle)))
    settle(docs.sparkSession)
    named = cut(nodes.join(root, nodes.tid == root.node, "left").select("tid", "first", F.coalesce("root", "tid").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = cut(named.join(least, "root").select("tid", "component_id", "root"), "labels")
    return scan.select("doc_id", "tid", "name").join(small(label, label.count()), "tid").select("doc_id", "tid", "name", "component_id", "root")
