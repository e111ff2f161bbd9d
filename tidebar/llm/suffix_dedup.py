"""Exact removal of long repeated byte strings by merging Burrows-Wheeler transforms.

Every window of WINDOW bytes is filed under its minimizer: the K-byte string in it with the least hash (leftmost on
ties). Equal windows have equal minimizers at equal places, so a window can only repeat within its minimizer's group, and
groups are indexed apart from each other. Consecutive windows with one minimizer form a segment. Every segment whose
minimizer occurs elsewhere is indexed: shards of segments get Burrows-Wheeler transforms, which are merged by interleave
refinement; where neighbours part gives their common prefix, and the intervals with a common prefix of WINDOW bytes and
two entries or more are the repeats. A kind of segment that occurs more than once in a group stands there once, with its
weight; where a group has but one kind, as inside copied passages, two runs of consecutive such segments, the first and
the last that hold them, are indexed as two strings.

A group too large for one merge is parted by what stands beside its minimizer: windows with at least half of their other
bytes on the left by those, the others by as many bytes on the right; again and again until the parts fit.

Everything but the transforms is DataFrame joins and aggregates; a text never leaves its row except as a segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.bwt import repeated_windows
from tidebar.llm.common import cut, keyed, small, texts

WINDOW = 200
K = 64
CHUNK = 1 << 18
#: Bytes of one minimizer's segments that are merged at once; larger groups are parted first.
GROUP_BYTES = 60_000
#: Windows of a run of segments that are indexed together.
RUN = 20_000
#: Bytes of segments whose transforms are merged together.
MERGE_BYTES = 60_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


class _Roller:
    """Hashes of substrings of a chunk from prefix sums of byte * base^position modulo 2^64."""

    def __init__(self, size: int):
        self.up, self.down = [], []
        for b in BASES:
            up = np.ones(size + 1, np.uint64)
            up[1:] = np.uint64(b)
            self.up.append(np.multiply.accumulate(up))
            down = np.ones(size + 1, np.uint64)
            down[1:] = np.uint64(pow(b, -1, 1 << 64))
            self.down.append(np.multiply.accumulate(down))

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[which][: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.down[which][start])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size, width = len(x) - w + 1, 1
    while width * 2 <= w:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[:size], x[w - width : w - width + size])


def segments(data: np.ndarray, bounds: np.ndarray, roller: _Roller, window: int, k: int, chunk: int) -> Iterator[tuple]:
    """Yields (document, first window, windows, anchor's distance from the first window, key, two segment hashes) as arrays, chunk by chunk."""
    n, width = len(data), window - k + 1
    lens = np.diff(bounds)
    for c0 in range(0, n - window + 1, chunk):
        b = data[c0 : min(n, c0 + chunk + window - 1)]
        size = len(b) - window + 1
        if size <= 0:
            break
        first, last = np.searchsorted(bounds, [c0, c0 + size - 1], side="right") - 1
        valid = np.zeros(size, bool)
        doc = np.zeros(size, np.int32)
        for d in range(first, last + 1):
            s, e = max(int(bounds[d]) - c0, 0), int(bounds[d + 1]) - window - c0 + 1
            if lens[d] >= window and e > s:
                valid[s:e] = True
                doc[s:e] = d
        if not valid.any():
            continue
        s1, s2 = roller.sums(b, 0), roller.sums(b, 1)
        m = len(b) - k + 1
        grams = _mix((s1[k:] - s1[:m]) * roller.down[0][:m])
        mask = np.uint64((1 << 20) - 1)
        anchor = (_sliding_min((grams & ~mask) | np.arange(m, dtype=np.uint64), width) & mask).astype(np.int64)
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        stop = valid.copy()
        stop[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
        s, e = np.flatnonzero(new), np.flatnonzero(stop)
        yield doc[s], s + c0 - bounds[doc[s]], e - s + 1, anchor[s] - s, grams[anchor[s]], roller.of(s2, s, e + window, 1), roller.of(s1, s, e + window, 0)


def _bytes_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(name).cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


SEGMENTS = "tid long, start long, n int, anchor int, key long, c1 long, c2 long"
#: A kind of segment: those of one key with one content (128 bits of hash).
KIND = ["key", "c1", "c2"]


def _scan(window: int, k: int):
    def run(batches):
        roller = _Roller(CHUNK + window)
        for batch in batches:
            data, bounds = _bytes_of(batch, "text")
            tid = batch.column("tid").to_numpy()
            for doc, start, n, anchor, *hashes in segments(data, bounds, roller, window, k, CHUNK):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tid[doc]), pa.array(start), pa.array(n.astype(np.int32)), pa.array(anchor.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in hashes)],
                    names=["tid", "start", "n", "anchor", *KIND],
                )

    return run


CONTENT = pa.schema([*((c, pa.int64()) for c in KIND), ("times", pa.int32()), ("n", pa.int32()), ("anchor", pa.int32()), ("width", pa.int32()), ("content", pa.binary())])
CONTENT_SQL = "key long, c1 long, c2 long, times int, n int, anchor int, width int, content binary"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)


def _cut_out(window: int):
    """From rows of text and segments (lists), the segments' bytes, a row each."""

    def run(batches):
        for batch in batches:
            out = []
            for text, segs in zip(batch.column("text"), batch.column("segs").to_pylist()):
                raw = memoryview(text.as_buffer())
                for s in segs:
                    out.append((s["key"], s["c1"], s["c2"], s["copy"], s["n"], s["anchor"], s["width"], bytes(raw[s["start"] : s["start"] + s["n"] + window - 1])))
                    if len(out) >= 5000:
                        yield _rows(out, CONTENT)
                        out = []
            yield _rows(out, CONTENT)

    return run


def _hash(*parts: bytes) -> tuple[int, int]:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(len(p).to_bytes(8, "little") + p)
    return int.from_bytes(h.digest()[:8], "little", signed=True), int.from_bytes(h.digest()[8:], "little", signed=True)


HALVES = pa.schema([("p0", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("off", pa.int32()), *CONTENT])
HALVES_SQL = f"p0 long, p1 long, p2 long, off int, {CONTENT_SQL}"


def _halve(window: int):
    """Parts each segment in two, whose common string is longer by half of what a window has beside it."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                c, at, width = r["content"], r["anchor"], r["width"]
                left = -(-(window - width) // 2)
                right = window - width - left + 1
                first = max(0, min(r["n"], at - left + 1))  # windows with `left` bytes or more before the common string
                halves = []
                if first:
                    halves.append((0, first, at - left, width + left, b"left", c[at - left : at]))
                if first < r["n"]:
                    halves.append((first, r["n"] - first, at - first, width + right, b"right", c[at + width : at + width + right]))
                for off, n, anchor, wide, side, beside in halves:
                    content = c[off : off + n + window - 1]
                    key = _hash(r["key"].to_bytes(8, "little", signed=True), side, beside)[0]
                    out.append((r["key"], r["c1"], r["c2"], off, key, *_hash(content), r["times"], n, anchor, wide, content))
                if len(out) >= 5000:
                    yield _rows(out, HALVES)
                    out = []
            yield _rows(out, HALVES)

    return run


HITS = pa.schema([*((c, pa.int64()) for c in KIND), ("off", pa.int32()), ("n", pa.int32())])
HITS_SQL = "key long, c1 long, c2 long, off int, n int"


def _index(window: int, merge_bytes: int):
    """Over a partition sorted by kind: indexes whole groups of segments, merge_bytes at a time, and yields the repeated
    runs of windows of each kind. times: 1; 2 where the kind occurs more than once; 0 and 1 for the two rows of a run."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        hits = repeated_windows([r["content"] for r in rows], np.array([r["n"] for r in rows]), window, weight=np.array([r["times"] for r in rows]))
        out, before = [], None
        for r, found in zip(rows, hits):
            kind = (r["key"], r["c1"], r["c2"])
            if kind != before and found.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], found.view(np.int8), [0]))))
                out += [(*kind, int(a), int(b - a)) for a, b in edge.reshape(-1, 2)]
            before = kind
        return _rows(out, HITS)

    def run(batches):
        held: list[dict] = []
        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                if held and all(r[c] == held[-1][c] for c in (*KIND, "times")):  # the text came twice
                    continue
                if size >= merge_bytes and r["key"] != held[-1]["key"]:
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["content"])
        if held:
            yield solve(held)

    return run


def repeated_kinds(rows: DataFrame, window: int, group_bytes: int, merge_bytes: int) -> DataFrame:
    """(key, c1, c2, off, n): in segments of that kind the n windows from `off` on also start elsewhere. rows: see CONTENT;
    times: see _index."""
    of_kind = lambda df: df.select(*KIND, "times", "n", "anchor", "width", "content")
    levels, found = [], []
    while True:
        sizes = rows.groupBy("key").agg(F.sum(F.octet_length("content") * F.greatest("times", F.lit(1))).alias("bytes"), F.sum(F.greatest("times", F.lit(1))).alias("m"))
        large = cut(sizes.where((F.col("bytes") > group_bytes) & (F.col("m") > 1)).select("key"), "large")
        n_large = large.count()
        wide = F.col("width") < window  # else the windows are all alike, or a run
        parted = of_kind(rows.where(wide).join(small(large, n_large), "key", "left_semi")) if n_large else None
        fits = of_kind(rows.where(~wide).unionAll(rows.where(wide).join(small(large, n_large), "key", "left_anti"))) if n_large else of_kind(rows)
        found.append(fits.repartition("key").sortWithinPartitions(*KIND, "times").mapInArrow(_index(window, merge_bytes), HITS_SQL))
        if parted is None:
            break
        halves = cut(parted.dropDuplicates([*KIND, "times"]).mapInArrow(_halve(window), HALVES_SQL), "halves")
        levels.append(cut(halves.select("p0", "p1", "p2", F.col("off").alias("at"), *KIND).distinct(), "parts"))
        kinds = halves.groupBy(*KIND).agg(F.least(F.sum("times"), F.lit(2)).cast("int").alias("times"), *[F.first(c).alias(c) for c in ("n", "anchor", "width", "content")])
        rows = cut(kinds, "kinds")
    hits = found.pop()
    while levels:
        up = levels.pop().join(hits, KIND).select(F.col("p0").alias("key"), F.col("p1").alias("c1"), F.col("p2").alias("c2"), (F.col("at") + F.col("off")).alias("off"), "n")
        hits = found.pop().unionAll(up)
    return hits


def _finish(batches):
    for batch in batches:
        n_removed, n_spans, kept = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            raw = memoryview(text.as_buffer())
            left, at = hashlib.sha256(), 0
            for s in spans or ():
                left.update(raw[at : s["start"]])
                at = s["end"]
            left.update(raw[at:])
            n_removed.append(sum(s["end"] - s["start"] for s in spans or ()))
            n_spans.append(len(spans or ()))
            kept.append(left.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(x.as_buffer()) for x in batch.column("text")], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_runs(docs: DataFrame, window: int = WINDOW, k: int = K, group_bytes: int = GROUP_BYTES, merge_bytes: int = MERGE_BYTES) -> DataFrame:
    """(tid, start, n): in the text with key tid, n windows from byte `start` on also start elsewhere. docs: doc_id, tid, text."""
    segs = cut(docs.select("tid", "text").mapInArrow(_scan(window, k), SEGMENTS), "segments")
    keys = cut(segs.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "keys")
    again = cut(segs.join(small(keys, keys.count()), "key"), "again")  # cut, so that a hot key's side of a join can be split
    at = F.struct("tid", "start", "n", "anchor")
    kinds = cut(again.groupBy(*KIND).agg(F.count("*").alias("m"), F.min(at).alias("lo"), F.max(at).alias("hi")), "kinds")
    lone = kinds.groupBy("key").agg(F.count("*").alias("of_key"), F.first("c1").alias("c1"), F.first("c2").alias("c2"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    lone = cut(lone, "groups")
    mixed = kinds.join(lone.where("of_key > 1").select("key"), "key").select(*KIND, F.least("m", F.lit(2)).cast("int").alias("copy"), "lo.*", F.lit(k).alias("width"))
    lone = lone.where("of_key = 1").withColumn("apart", F.col("hi.start") - F.col("lo.start"))
    same = Window.partitionBy("lo.tid", "hi.tid", "apart").orderBy("lo.start")
    fresh = F.coalesce(F.col("lo.start") != F.lag(F.col("lo.start") + F.col("lo.n")).over(same), F.lit(True))
    lone = lone.withColumn("begin", F.max(F.when(fresh, F.col("lo.start"))).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lone = lone.withColumn("piece", F.floor((F.col("lo.start") - F.col("begin")) / RUN))
    run = ["lo.tid", "hi.tid", "apart", "begin", "piece"]
    named = [F.xxhash64(F.lit(i), *run).alias(f"p{i}") for i in range(3)]
    lone = cut(lone.select(*KIND, "lo", "hi", *named, F.min("lo.start").over(Window.partitionBy(*run)).alias("begin")), "lone")
    pairs = lone.groupBy("p0", "p1", "p2").agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.sum("lo.n").cast("int").alias("n"))
    pairs = pairs.select(F.col("p0").alias("key"), F.col("p1").alias("c1"), F.col("p2").alias("c2"), F.posexplode(F.array("lo", "hi")).alias("copy", "at"), "n")
    pairs = pairs.select(*KIND, "copy", "at.tid", "at.start", "n", F.lit(0).alias("anchor"), F.lit(window).alias("width"))  # not to be parted
    todo = mixed.unionAll(pairs)
    per_text = cut(todo.groupBy("tid").agg(F.collect_list(F.struct(*KIND, "copy", "start", "n", "anchor", "width")).alias("segs")), "per_text")
    n_texts, n_segs = per_text.agg(F.count("*"), F.sum(F.size("segs"))).first()
    first = docs.groupBy("tid").agg(F.min("doc_id").alias("first")).join(per_text.select(F.col("tid").alias("t")), F.col("tid") == F.col("t")).select("t", "first")
    one = docs.join(small(first, n_texts), (F.col("tid") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    content = one.join(small(per_text, n_texts, 8 + 64 * (n_segs or 0) // max(n_texts, 1)), "tid").select("text", "segs")
    rows = cut(content.mapInArrow(_cut_out(window), CONTENT_SQL), "content")
    hits = cut(repeated_kinds(rows, window, group_bytes, merge_bytes), "hits")
    of_run = hits.select(F.col("key").alias("p0"), F.col("c1").alias("p1"), F.col("c2").alias("p2"), "off", F.col("n").alias("long"))
    within = lone.join(of_run, ["p0", "p1", "p2"]).withColumn("skip", F.col("lo.start") - F.col("begin"))  # the part of a run's hits in each of its segments
    low, high = F.greatest(F.col("off") - F.col("skip"), F.lit(0)), F.least(F.col("off") + F.col("long") - F.col("skip"), F.col("lo.n"))
    within = within.select(*KIND, low.cast("int").alias("off"), (high - low).cast("int").alias("n")).where("n > 0")
    runs = again.select(*KIND, "tid", "start").join(hits.unionAll(within), KIND).select("tid", (F.col("start") + F.col("off")).alias("start"), "n")
    return cut(runs.distinct(), "runs")


def _joined(window: int):
    """Of each text's runs of windows the bytes that they cover: maximal (start, end) in order."""

    def run(batches):
        for batch in batches:
            spans = []
            for runs in batch.column("runs").to_pylist():
                x = np.array([(r["start"], r["start"] + r["n"] + window - 1) for r in runs], np.int64)
                x = x[np.argsort(x[:, 0], kind="stable")]
                reach = np.maximum.accumulate(x[:, 1])
                new = np.concatenate(([True], x[1:, 0] > reach[:-1]))
                spans.append([{"start": a, "end": b} for a, b in zip(x[new, 0].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["tid", "spans"])

    return run


def suffix_dedup(documents: DataFrame, window: int = WINDOW, k: int = K, **sizes: int) -> DataFrame:
    """Per document, what is left when every byte covered by a repeated string of `window` bytes is removed.

    documents: doc_id, text (extra columns are ignored); each row is a document, so a repeated row is a copy. A null text
    is empty; texts shorter than `window` bytes keep all. Empty tables give no rows. Bytes are UTF-8; what is left need
    not be valid UTF-8. `window` must be a multiple of 8 and k less than it."""
    docs = keyed(texts(documents))
    runs = repeated_runs(docs, window, k, **sizes)
    spans = runs.groupBy("tid").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    spans = cut(spans.mapInArrow(_joined(window), "tid long, spans array<struct<start:long,end:long>>"), "spans")
    n_texts, n_spans = spans.agg(F.count("*"), F.sum(F.size("spans"))).first()
    joined = docs.join(small(spans, n_texts, 8 + 24 * (n_spans or 0) // max(n_texts, 1)), "tid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
