"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints within three bits differ by one bit at most in one of their two halves. Each half is filed once as it is and
once for each of its bits with that bit left out; fingerprints that share an entry are compared. The work is done on
distinct fingerprints: a group of copies is one. Entries that many share are dealt into tiles, and of what a tile links
only a star for each linked group leaves it, not the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import cut, drop, small, texts

SHINGLE = 3
DISTANCE = 3
TILE = 2048


def fingerprint(text: str | bytes, shingle: int = SHINGLE) -> int:
    """64 bits; bit i is set where over half of the shingles' hashes have it. No words: 0."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    hashes = np.array([h(joined[s:e], 42) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def variants(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (half, bit left out or none, the rest of the half, as one number) and the fingerprint of each."""
    keys = []
    for side in (0, 1):
        half = (fp >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)
        for bit in range(33):  # 32: none left out
            rest = half if bit == 32 else half & ~np.uint64(1 << bit)
            keys.append(rest | np.uint64((side * 33 + bit) << 32))
    return np.concatenate(keys), np.tile(fp, len(keys))


def _file(batches):
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(fp), 4000):
            keys, who = variants(fp[at : at + 4000])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(who.view(np.int64))], names=["key", "fp"])


def stars(a: np.ndarray, b: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links between fingerprints of a and of b within the distance, as a star (member, least member) for each linked group."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= distance
    label = np.arange(len(nodes))
    far = len(nodes)
    while True:
        old = label.copy()
        to_a = np.where(near, label[ib][None, :], far).min(axis=1, initial=far)
        np.minimum.at(label, ia, to_a)
        to_b = np.where(near, label[ia][:, None], far).min(axis=0, initial=far)
        np.minimum.at(label, ib, to_b)
        label = label[label]
        if (label == old).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return list(zip(nodes[moved].tolist(), nodes[label[moved]].tolist()))


def _split(key: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two sides to compare: with and without the bit that the entry leaves out; all against all where it leaves out none."""
    side, bit = divmod(int(key) >> 32, 33)
    if bit == 32:
        return members, members
    one = (members >> np.uint64(32 * side + bit)) & np.uint64(1) == 1
    return members[one], members[~one]


LINKS = "a long, b long, key long"


def _link(distance: int, tile: int):
    """Over a partition sorted by entry: links of entries with up to `tile` members; the members of larger ones as rows with a key."""

    def solve(key: np.ndarray, fp: np.ndarray):
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(start, len(key)))
        bit = ((key >> 32) % 33).astype(np.uint64)
        side = ((key >> 32) // 33).astype(np.uint64)
        ones = (fp >> (np.uint64(32) * side + np.minimum(bit, np.uint64(31)))) & np.uint64(1)
        ones[bit == 32] = 0
        set_ = np.add.reduceat(ones.astype(np.int64), start)
        useful = (n > 1) & ((bit[start] == 32) | ((set_ > 0) & (set_ < n)))
        pair = start[useful & (n == 2)]
        near = np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= distance
        a, b = fp[pair][near], fp[pair + 1][near]
        links = [(np.maximum(a, b), np.minimum(a, b))]
        late = [np.zeros(0, np.int64)]
        for s, m in zip(start[useful & (n > 2)], n[useful & (n > 2)]):
            if m > tile:
                late.append(np.arange(s, s + m))
                continue
            found = stars(*_split(key[s], fp[s : s + m]), distance)
            if found:
                x, y = zip(*found)
                links.append((np.array(x, np.uint64), np.array(y, np.uint64)))
        a, b = (np.concatenate(x) for x in zip(*links))
        late = np.concatenate(late)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])
        if len(late):
            yield pa.RecordBatch.from_arrays([pa.array(fp[late].view(np.int64)), pa.nulls(len(late), pa.int64()), pa.array(key[late])], names=["a", "b", "key"])

    def run(batches):
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate((key, batch.column("key").to_numpy()))
            fp = np.concatenate((fp, batch.column("fp").to_numpy().view(np.uint64)))
            if key[0] == key[-1] and len(key) > 4 * tile:  # one entry fills what is held: it is large
                yield pa.RecordBatch.from_arrays([pa.array(fp[:-tile - 1].view(np.int64)), pa.nulls(len(fp) - tile - 1, pa.int64()), pa.array(key[:-tile - 1])], names=["a", "b", "key"])
                key, fp = key[-tile - 1 :], fp[-tile - 1 :]
                continue
            whole = np.searchsorted(key, key[-1]) if len(key) else 0
            if whole:
                yield from solve(key[:whole], fp[:whole])
                key, fp = key[whole:], fp[whole:]
        if len(key):
            yield from solve(key, fp)

    return run


def _tiles(distance: int):
    def run(key, table):
        fp, right = table.column("fp").to_numpy().view(np.uint64), table.column("right").to_numpy(zero_copy_only=False)
        entry, i, j = (k.as_py() for k in key)
        left = fp[~right]
        if i == j:
            found = stars(*_split(entry, left), distance)
        else:
            (a, b), (c, d) = _split(entry, left), _split(entry, fp[right])
            found = stars(a, d, distance) + ([] if (entry >> 32) % 33 == 32 else stars(c, b, distance))
        x, y = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(np.array(x, np.uint64).view(np.int64)), "b": pa.array(np.array(y, np.uint64).view(np.int64))})

    return run


def links(fps: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """fps: fp (long, distinct). (a, b) such that fingerprints within the distance are connected, and no others."""
    filed = fps.select("fp").mapInArrow(_file, "key long, fp long")
    found = cut(filed.repartition("key").sortWithinPartitions("key").mapInArrow(_link(distance, tile), LINKS), "links")
    out = found.where("key is null").select("a", "b")
    late = found.where("key is not null").select("key", F.col("a").alias("fp"))
    sizes = late.groupBy("key").agg(F.count("*").alias("m"))
    most = sizes.agg(F.max("m")).first()[0]
    if most:
        dealt = late.join(sizes, "key").withColumn("t", F.ceil(F.col("m") / tile)).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("t")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1)))
        dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"), "fp")
        out = out.union(dealt.groupBy("key", "i", "j").applyInArrow(_tiles(distance), "a long, b long"))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the least node reachable. Large star and small star in turn, until nothing changes."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    held, state = e, None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        e = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        before, e = held, cut(e, "edges")
        held = e
        drop(before)
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id of its group).

    documents: doc_id, text (extra columns are ignored). Null and empty texts and those without words have fingerprint
    zero and are linked like any other. Repeated rows are documents with one fingerprint. An empty table gives no rows.
    The distance may be 3 at most."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves with one bit left out find up to three differing bits")
    docs = cut(texts(documents).mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "fingerprints")
    fps = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(fps, distance, tile))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = cut(named, "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = cut(named.join(least, "root").select("fp", "component_id"), "labels")
    joined = docs.join(small(label, label.count()), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
