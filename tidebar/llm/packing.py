"""Packing tokenized documents into sequences: best fit, then swap-based local search.

What fits together depends on lengths alone, so packing is solved over the histogram of lengths: at most `size` numbers,
whatever the corpus. Best fit in decreasing order fills bins of equal content together. The local search then takes
underfull kinds of bins in pairs and moves documents, exchanges one for one, or two for one, wherever that increases the
sum of squared fills, until bins empty. A plan (kinds of bins with counts) of bounded size goes to the executors, where
each piece finds its place from its length and its number among the pieces of that length.
"""

from __future__ import annotations

import bisect
import os
import string
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import cut, lean, short_batches, texts

SIZE = 2048
END = 0
TOKENIZER = "byte_bpe_50k.json"
#: Pieces of one length that are numbered together, about: a frequent length is many buckets.
BUCKET = 500


#: Characters of texts that are encoded together, about, and units that the tokenizer is asked for together.
GROUP = 2_000_000
ASKED = 16_000
#: Bytes up to which a unit's ids are remembered, and how many units are.
UNIT = 64
UNITS = 400_000


@lru_cache(maxsize=1)
def _tokenizer(file: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Tokenizer.from_file(public_tokenizers.path(file))


@lru_cache(maxsize=1)
def _token_bytes(file: str) -> np.ndarray:
    """Bytes of each id: a token's characters stand for a byte each."""
    vocab = _tokenizer(file).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    return out


_WHITE, _WORD = b" \t\n\r", (string.ascii_letters + string.digits).encode()
_MARK = string.punctuation.encode()
#: A text may be parted where the byte before and the byte after share a bit: 1 is white space after anything else, 2 a
#: mark after a letter or digit. Of bytes beyond ASCII the characters are looked at as well.
_BEFORE = bytes(3 if i > 127 or i in _WORD else i in _MARK for i in range(256))
_AFTER = bytes((i in _WHITE) + 2 * (i in _MARK) for i in range(256))


def _may_be_white(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place may be white space or a control character, to be on the safe side."""
    a, b, c = (np.where(ends > k, data[np.maximum(ends - 1 - k, 0)], 0) for k in range(3))
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    general = (c == 0xE2) & ((b == 0x81) | ((b == 0x80) & ((a <= 0x8F) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))))
    three = general | ((c == 0xE1) & (((b == 0x9A) & (a == 0x80)) | ((b == 0xA0) & (a == 0x8E)))) | ((c == 0xE3) & (b == 0x80) & (a == 0x80))
    return np.where(a < 0x80, (a <= 0x20) | (a == 0x7F), two | three)


def _places(raw: bytes, starts: np.ndarray, whole: list[tuple[int, int]]) -> np.ndarray:
    """Where the units of texts (UTF-8, one after another) begin: at the texts' starts, before white space that follows
    none, and before an ASCII mark that follows a letter (ASCII or Latin-1) or an ASCII digit.

    The tokenizer's own pieces end at all of these places, and what it makes of a unit doesn't depend on those around it.
    Spans in whole are not parted."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.zeros(len(data), np.uint8)
    np.bitwise_and(np.frombuffer(raw.translate(_BEFORE), np.uint8)[:-1], np.frombuffer(raw.translate(_AFTER), np.uint8)[1:], out=edge[1:])
    for i, j in whole:
        edge[i:j] = 0
    edge[starts] = 4
    at = np.flatnonzero(edge)
    unsure = np.flatnonzero((edge[at] != 4) & (data[at - 1] > 127))
    places = at[unsure]
    latin = (data[places - 2] == 0xC3) & (data[places - 1] != 0x97) & (data[places - 1] != 0xB7)
    keep = np.ones(len(at), bool)
    keep[unsure] = np.where(edge[places] == 1, ~_may_be_white(data, places), latin)
    return at[keep]


def _bounds(strings: pa.LargeBinaryArray) -> np.ndarray:
    return np.zeros(1, np.int64) if not len(strings) else np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, 8 * strings.offset)


def _strings(bounds: np.ndarray, data, null: np.ndarray | None = None) -> pa.LargeBinaryArray:
    valid = None if null is None else pa.py_buffer(np.packbits(~null, bitorder="little"))
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [valid, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)])


class Encoder:
    """Ids of texts by the tokenizer, asked once for texts that come together and for units that recur.

    Units and their ids are columns of bytes; a unit's ids are found by its number in the dictionary of units."""

    def __init__(self, file: str = TOKENIZER):
        self.tokenizer = _tokenizer(file)
        self.bytes = _token_bytes(file)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = self.ids = pa.array([], pa.large_binary())

    def _all(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _parted(self, text: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the text and how many of them come before each of its ends, by the tokens' lengths."""
        (found,) = self._all([text.decode()])
        ids = np.array(found.ids, "<u4")
        stops = np.cumsum(self.bytes[ids])
        at = np.searchsorted(stops, ends)
        if len(ids) == 0 or stops[-1] != len(text) or (stops[at] != ends).any():
            raise ValueError("the tokens' lengths don't add up to the units'")
        return ids, at + 1

    def _learn(self, fresh: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """Ids of units that begin with white space or a mark. Those that begin with white space are asked for as one text,
        those with a mark in lines, and those that may end in white space, which only ends of texts do, alone."""
        bounds = _bounds(fresh)
        data = np.frombuffer(fresh.buffers()[2], np.uint8)
        alone = _may_be_white(data, bounds[1:])
        white = np.isin(data[bounds[:-1]], np.frombuffer(_WHITE, np.uint8))
        order, parts, sizes = [], [], []
        for mask, gap in ((white & ~alone, b""), (~white & ~alone, b"\n")):
            chosen = np.flatnonzero(mask)
            for i in range(0, len(chosen), ASKED):
                at = chosen[i : i + ASKED]
                asked = fresh.take(pa.array(at))
                text = gap.join(asked.to_pylist()) if gap else asked.buffers()[2].to_pybytes()[: _bounds(asked)[-1]]
                ends = np.cumsum(bounds[at + 1] - bounds[at] + len(gap)) - len(gap)
                if not gap:
                    ids, stops = self._parted(text, ends)
                    n = np.diff(stops, prepend=0)
                else:  # a line's end is a token of its own
                    ids, stops = self._parted(text, np.sort(np.concatenate([ends, ends[:-1] + 1])))
                    n = np.diff(stops, prepend=0)
                    ids, n = ids[np.repeat(np.arange(len(n)) % 2 == 0, n)], n[::2]
                order.append(at)
                parts.append(ids.tobytes())
                sizes.append(n)
        at = np.flatnonzero(alone)
        if len(at):
            found = [np.array(x.ids, "<u4") for x in self._all([x.decode() for x in fresh.take(pa.array(at)).to_pylist()])]
            order.append(at)
            parts.extend(x.tobytes() for x in found)
            sizes.append(np.array([len(x) for x in found]))
        out = _strings(np.append(0, 4 * np.cumsum(np.concatenate(sizes))), b"".join(parts))
        order = np.concatenate(order)
        return out if (order[1:] > order[:-1]).all() else out.take(pa.array(np.argsort(order)))

    def _forget(self) -> None:
        """Keeps short units, and of too many the half that came first, as they recur most."""
        short = np.flatnonzero(np.diff(_bounds(self.known)) <= UNIT)
        if len(short) > UNITS:
            short = short[: UNITS // 2]
        if len(short) < len(self.known):
            self.known, self.ids = (x.take(pa.array(short)) for x in (self.known, self.ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as uint32."""
        once = list(dict.fromkeys(texts))
        utf8 = [text.encode() for text in once]
        raw = b"".join(utf8)
        if not raw:
            return [np.empty(0, "<u4") for _ in texts]
        bounds = np.cumsum([0, *map(len, utf8)])
        starts = bounds[:-1][np.diff(bounds) > 0]
        spans = zip(once, bounds.tolist(), bounds[1:].tolist())
        at = np.append(_places(raw, starts, [(i, j) for text, i, j in spans if any(t in text for t in self.added)]), len(raw))
        heads = np.searchsorted(at, starts)  # a text's first unit is asked for alone: it may begin with anything
        found = self._all([raw[i:j].decode() for i, j in zip(starts.tolist(), at[heads + 1].tolist())])
        first = iter([np.array(x.ids, "<u4") for x in found])
        head = np.zeros(len(at) - 1, bool)
        head[heads] = True
        coded = pa.concat_arrays([self.known, _strings(at, raw, head)]).dictionary_encode()
        if len(coded.dictionary) > len(self.known):
            self.ids = pa.concat_arrays([self.ids, self._learn(coded.dictionary[len(self.known) :])])
        ids = self.ids.take(coded.indices[len(self.known) :])  # nothing for a first unit
        self.known = coded.dictionary
        self._forget()
        stops = _bounds(ids)[np.searchsorted(at, bounds)] // 4
        flat = np.frombuffer(ids.buffers()[2] or b"", "<u4", stops[-1])
        out = {text: np.concatenate([next(first), flat[i:j]]) if text else flat[:0] for text, i, j in zip(once, stops.tolist(), stops[1:].tolist())}
        return [out[text] for text in texts]


def _encoded(texts: pa.Array, ids_of) -> Iterator[np.ndarray]:
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1])
        if size >= GROUP:
            yield from ids_of(held)
            held, size = [], 0
    yield from ids_of(held)


def _pieces(size: int, file: str):
    def run(batches):
        ids_of = Encoder(file).encode  # a task's own: workers live on, and shall not keep what it remembers
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), _encoded(batch.column("text"), ids_of)):
                ids = np.append(ids, np.uint32(END))
                first = len(ids) % size or size
                start, stop, k = 0, min(first, len(ids)), 0
                while start < len(ids):
                    out.append((doc, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start, stop, k = stop, stop + size, k + 1
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(counts: dict[int, int], size: int, order=None) -> Counter:
    """Kinds of bins (lengths in decreasing order) and how many of each, by best fit, the lengths in the given order (by
    default decreasing).

    Bins of one kind are filled together, so the work follows the number of kinds, not of pieces."""
    done: Counter = Counter()
    open_bins: dict[int, list[list]] = defaultdict(list)  # room left: [kind, count]
    rooms: list[int] = []

    def put(kind: tuple, n: int) -> None:
        room = size - sum(kind)
        if not room:
            done[kind] += n
            return
        if not open_bins[room]:
            bisect.insort(rooms, room)
        open_bins[room].append([kind, n])

    for length in order or sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = size // length
                full, rest = divmod(n, each)
                if full:
                    put((length,) * each, full)
                if rest:
                    put((length,) * rest, 1)
                break
            room = rooms[i]
            kind, have = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(i)
            each = min(room // length, n)
            take = min(have, n // each)
            if have > take:
                put(kind, have - take)
            put(tuple(sorted(kind + (length,) * each, reverse=True)), take)
            n -= take * each
    for room in rooms:
        for kind, n in open_bins[room]:
            done[kind] += n
    return done


def _better(a: tuple, b: tuple, size: int) -> tuple[tuple, tuple] | None:
    """Bins a (fuller) and b after the move or exchange that increases the sum of squared fills most, or None."""
    fill_a, fill_b = sum(a), sum(b)
    room = size - fill_a
    best, found = 0, None
    items_a, items_b = sorted(set(a)), sorted(set(b))
    two_b = sorted({x + y for i, x in enumerate(b) for y in b[i + 1 :]})
    for gives, gets in ((((),), items_b), (((x,) for x in items_a), items_b), (((x,) for x in items_a), two_b)):
        for give in gives:
            i = bisect.bisect_right(gets, room + sum(give)) - 1
            gain = gets[i] - sum(give) if i >= 0 else 0
            if gain > best:
                best, found = gain, (give, gets[i], gets is two_b)
    if not found or (fill_a + best) ** 2 + (fill_b - best) ** 2 <= fill_a**2 + fill_b**2:
        return None
    give, got, two = found
    taken = next((x, y) for i, x in enumerate(b) for y in b[i + 1 :] if x + y == got) if two else (got,)
    new_a, new_b = list(a), list(b)
    for x in give:
        new_a.remove(x)
    for x in taken:
        new_b.remove(x)
    return tuple(sorted([*new_a, *taken], reverse=True)), tuple(sorted([*new_b, *give], reverse=True))


def local_search(bins: Counter, size: int) -> Counter:
    """Improves a packing: the emptiest kind of bin gives to the fuller underfull ones until it is empty or nothing helps.

    It ends when no pair of kinds can improve or no bin can be saved. A giver that nothing helped is asked again for takers
    that came or grew since; each step increases the sum of squared fills, so there are finitely many."""
    bins = +Counter(bins)
    under = sorted((sum(k), k) for k in bins if sum(k) < size)
    room = sum((size - fill) * bins[k] for fill, k in under)  # steps move pieces: only emptied bins change it
    changed, tried, step = dict.fromkeys(bins, 0), {}, 0

    def put(kind: tuple, n: int) -> None:
        if n > 0:
            changed[kind] = step
        if sum(kind) < size and not bins[kind]:
            bisect.insort(under, (sum(kind), kind))
        bins[kind] += n
        if not bins[kind]:
            del bins[kind]
            if sum(kind) < size:
                under.pop(bisect.bisect_left(under, (sum(kind), kind)))

    at = 0
    while room >= size and at < len(under):
        giver, hit = under[at][1], None
        since = tried.get(giver, -1)
        for _, taker in reversed(under):
            if changed[taker] <= since or (taker == giver and bins[giver] < 2):
                continue
            if hit := _better(taker, giver, size):
                break
        if hit is None:
            tried[giver] = step
            at += 1
            continue
        step += 1
        n = bins[giver] // 2 if taker == giver else min(bins[giver], bins[taker])
        put(giver, -n)
        put(taker, -n)
        put(hit[0], n)
        if hit[1]:
            put(hit[1], n)
        else:
            room -= size * n
        at = 0
    return bins


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first number of that length, how many, slots of that length in a bin, first sequence, offset of the first slot)."""
    bins = local_search(best_fit(counts, size), size)
    used: Counter = Counter()
    rows, sequence = [], 0
    for kind, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length, slots in sorted(Counter(kind).items(), reverse=True):
            rows.append((length, used[length], n * slots, slots, sequence, offset))
            used[length] += n * slots
            offset += length * slots
        sequence += n
    return rows


def _place(rows: list[tuple]):
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for r in rows:
        by_length[r[0]].append(r)
    tables = {k: np.array(v, np.int64) for k, v in by_length.items()}

    def run(batches):
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                t = tables[int(x)]
                i = np.searchsorted(t[:, 1], number[at], side="right") - 1
                within = number[at] - t[i, 1]
                seq[at] = t[i, 4] + within // t[i, 3]
                off[at] = t[i, 5] + within % t[i, 3] * x
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(documents: DataFrame, size: int = SIZE, bucket: int = BUCKET, tokenizer: str = TOKENIZER) -> DataFrame:
    """Packs documents (doc_id, text; extra columns are ignored) into sequences of at most `size` tokens; a row for each piece.

    A document is its text's ids and an end mark; a null text is empty, so only the mark. Only longer documents are cut,
    into pieces of `size`, the first of which may be shorter. Repeated rows are documents of their own. An empty table
    gives no rows."""
    pieces = texts(documents).mapInArrow(lean(_pieces(size, tokenizer)), "doc_id long, piece int, start long, length long, ids_crc32 long")
    with short_batches(documents.sparkSession):
        pieces = cut(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    buckets = max(1, -(-max(counts.values(), default=1) // bucket))
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    pieces = pieces.withColumn("part", part)
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("length", "part", before.alias("first"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("k", F.row_number().over(order)).join(first, ["length", "part"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("k") - 1).alias("number"))
    return numbered.mapInArrow(_place(plan(counts, size)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
