"""Places of a regex's matches as Columns: which built-in functions don't give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
CHUNK = 4096
NONE = "array<struct<start:long,end:long,match:string>>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda that uses an expression from outside computes it for each element."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, regex: str) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(0))


def _blocks(items: Column) -> Column:
    """The items in arrays of BLOCK."""
    return let(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, BLOCK)))


def _scan(items: Column, kind: str, add, total) -> Column:
    """Of each item what add(state, item) gives as `out`, the states running over the items; total(state, block): the
    state after a block. Blocks and items of a block are scanned in turn, so that many items don't take quadratic time."""
    zero, none = F.lit(0).cast("long"), F.array()
    bases = lambda blocks: F.aggregate(blocks, F.struct(zero.alias("at"), none.cast("array<long>").alias("all")), lambda a, b: F.struct(total(a["at"], b).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])

    def within(block: Column, base: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            at, out = add(a["at"], s)
            return F.struct(at.alias("at"), F.concat(a["all"], F.array(out)).alias("all"))

        return F.aggregate(block, F.struct(base.alias("at"), none.cast(kind).alias("all")), step, lambda a: a["all"])

    return F.when(F.size(items) == 0, none.cast(kind)).otherwise(let(_blocks(items), lambda blocks: F.flatten(F.zip_with(blocks, bases(blocks), within))))


def placed(text: Column, regex: str, found: Column) -> Column:
    """Array of (start, end, match) of the matches `found` of a regex that doesn't match the empty string; code points, end exclusive."""
    gaps = F.split(text, regex, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))), found, lambda g, m: F.struct(F.char_length(g).cast("long").alias("gap"), F.coalesce(F.char_length(m), F.lit(0)).cast("long").alias("len"), m.alias("match")))

    def add(at: Column, s: Column) -> tuple[Column, Column]:
        start = at + s["gap"]
        return start + s["len"], F.struct(start.alias("start"), (start + s["len"]).alias("end"), s["match"].alias("match"))

    total = lambda at, block: F.aggregate(block, at, lambda a, s: a + s["gap"] + s["len"])
    return F.when(F.size(found) == 0, F.array().cast(NONE)).otherwise(_scan(steps, NONE, add, total))


def replaced(text: Column, spans: Column, written_as) -> Column:
    """text with each of the spans (sorted by start) replaced by written_as(span); of a span that overlaps one before
    only the characters after that one go, without a mark of its own. Linear in the text: pieces come from its chunks."""
    def piece(chunks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        held = F.array_join(F.slice(chunks, first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(held, (start % CHUNK + 1).cast("int"), (end - start).cast("int"))).otherwise("")

    before = _scan(spans, "array<long>", lambda at, s: (F.greatest(at, s["end"]), at), lambda at, block: F.greatest(at, F.array_max(F.transform(block, lambda s: s["end"]))))

    def done(chunks: Column) -> Column:
        parts = F.zip_with(spans, before, lambda s, at: F.when(s["start"] >= at, F.concat(piece(chunks, at, s["start"]), written_as(s))).otherwise(""))
        return F.concat(F.array_join(parts, ""), piece(chunks, F.array_max(F.transform(spans, lambda s: s["end"])), F.char_length(text).cast("long")))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), done)


def written(spans: Column) -> Column:
    """kind:start:end of an array of (…, kind, start, end), comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
