"""Personal data: patterns of fixed kinds, and bootstrapped contextual extraction for what they miss.

Spans of the fixed kinds are seeds. The two words before a seed are a lexical pattern; what stands behind a pattern
anywhere (a token with a digit or an at sign) is one of its instances. The graph of patterns and instances is scored in
rounds: a pattern by the mean belief in its instances, once enough of them are seeds or as good as sure; an unseen
instance by the best pattern that it stands behind. So instances that one round discovers are the next one's seeds, and
admit patterns that no seed stands behind. Slots behind patterns of high confidence are further identifiers. DataFrame
functions throughout; texts are read once, and only places, tokens and contexts go on.

The regexes are written so that matching takes linear time: a run is entered at its first character or where the match
before ended, and possessive quantifiers never give back what they can't use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import cut, small, text_name, texts
from tidebar.llm.spans import NONE, let, matches, placed, replaced, written

KINDS = ("email", "ip", "card", "phone")
REGEX = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARK = {"email": "@", "phone": "+"}
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
WORD = r"[^\x20\x09-\x0D]+"
#: Characters from which a word of a context is compared by its hash.
LONG = 40
SLOTS = "array<struct<start:long,end:long,match:string,pattern:string>>"
#: Rounds of scoring, seeds (or sure instances) that a pattern needs, and the score from which it counts as sure.
ROUNDS = 4
SEEDS = 5
SURE = 0.8


def _octet(part: str = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])") -> str:
    return rf"^(?:{part}\.){{3}}{part}$"


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_octet())
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _passing(kind: str, field: str = ""):
    return lambda x: passes(kind, x[field] if field else x)


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def contexts(text: Column) -> Column:
    """Of each token with a digit or an at sign the two words before it, in the order of the tokens: lower case, numbers as
    #, words with an at sign as @, a missing word as ^."""

    def classed(w: Column) -> Column:
        low = F.regexp_replace(F.lower(w), "[0-9]+", "#")
        return F.when(F.contains(w, F.lit("@")), "@").when(F.char_length(low) > LONG, F.md5(low)).otherwise(low)

    def pairs(words: Column) -> Column:
        named = F.transform(words, classed)
        of = lambda named: F.transform(words, lambda w, i: F.struct(w.rlike("[0-9@]").alias("slot"), F.concat_ws(" ", F.coalesce(F.get(named, i - 2), F.lit("^")), F.coalesce(F.get(named, i - 1), F.lit("^"))).alias("pattern")))
        return let(named, of)

    return F.transform(F.filter(let(matches(text, WORD), pairs), lambda x: x["slot"]), lambda x: x["pattern"])


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, tid, an array of (start, end, match) for each kind, and slots (with pattern): the tokens that could be identifiers."""
    nothing = F.array().cast("array<string>")
    docs = docs.withColumn("any", F.col("text").rlike("[0-9@]"))  # most texts have neither: one pass instead of five
    for kind in KINDS:
        possible = F.col("any") & F.contains("text", F.lit(MARK[kind])) if kind in MARK else F.col("any")
        docs = docs.withColumn(f"m_{kind}", F.when(possible, matches(F.col("text"), REGEX[kind])).otherwise(nothing))
        if kind in ("ip", "card"):  # most numbers are neither: don't place them where none passes
            docs = docs.withColumn(f"m_{kind}", F.when(F.exists(f"m_{kind}", _passing(kind)), F.col(f"m_{kind}")).otherwise(nothing))
    docs = docs.withColumn("m_slots", F.when(F.col("any"), matches(F.col("text"), TOKEN)).otherwise(nothing))
    cols = [F.when(F.size(f"m_{k}") == 0, F.array().cast(NONE)).otherwise(F.filter(placed(F.col("text"), REGEX[k], F.col(f"m_{k}")), _passing(k, "match"))).alias(k) for k in KINDS]
    with_context = F.zip_with(placed(F.col("text"), TOKEN, F.col("m_slots")), contexts(F.col("text")), lambda s, p: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), p.alias("pattern")))
    slots = F.when(F.size("m_slots") == 0, F.array().cast(SLOTS)).otherwise(with_context).alias("slots")
    return docs.select("doc_id", "tid", *cols, slots)


def occurrences(scan: DataFrame) -> DataFrame:
    """A row a slot that isn't inside a seed: doc_id, tid, pattern, instance, start, end and the kind of the seed that starts there (null: none)."""
    seeds = [scan.select("doc_id", "tid", F.explode(k).alias("s"), F.lit(k).alias("kind")) for k in KINDS]
    base = reduce(DataFrame.union, seeds).select("doc_id", "tid", "s.start", "s.end", "kind", F.lit("").alias("instance"), F.lit("").alias("pattern"))
    s = scan.select("doc_id", "tid", F.explode("slots").alias("s")).select("doc_id", "tid", "s.*")
    lead = F.char_length(F.regexp_extract("match", r"^[(\[{<\"'=:]*", 0)).cast("long")
    tail = F.char_length(F.regexp_extract("match", r"[)\]}>\"'.,;:!?]*$", 0)).cast("long")
    s = s.select("doc_id", "tid", (F.col("start") + lead).alias("start"), (F.col("end") - tail).alias("end"), F.lit(None).cast("string").alias("kind"), F.regexp_replace("match", r"^[(\[{<\"'=:]*|[)\]}>\"'.,;:!?]*$", "").alias("instance"), "pattern")
    rows = base.union(s.where(F.col("start") < F.col("end"))).distinct()
    w = Window.partitionBy("doc_id", "tid").orderBy("start", F.col("kind").asc_nulls_last())
    past, coming = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    is_seed = F.col("kind").isNotNull()
    rows = rows.withColumn("reach", F.max(F.when(is_seed, F.col("end"))).over(past)).withColumn("ahead", F.min(F.when(is_seed, F.col("start"))).over(coming))
    rows = rows.withColumn("at", F.max(F.when(is_seed, F.struct("start", "kind"))).over(past))
    here = F.when(F.col("at.start") == F.col("start"), F.col("at.kind"))
    clear = (F.coalesce(F.col("reach"), F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("ahead"), F.col("end")) >= F.col("end"))
    return rows.where(~is_seed & (here.isNotNull() | clear)).select("doc_id", "tid", "pattern", "instance", "start", "end", here.alias("kind"))


def patterns(found: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, sure: float = SURE) -> DataFrame:
    """(pattern, kind, score) of the sure patterns. found: pattern, instance, kind (null where unknown).

    Belief in a seed is 1. Each round scores a pattern for a kind by the sum of beliefs in its distinct instances over
    their number, if at least `seeds` of them are believed to be `sure` or more; then an unseen instance by the best score
    of its patterns. Rounds end early when no pattern's score changes."""
    edges = cut(found.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    seed = cut(edges.where("kind is not null").select("instance", "kind").distinct().withColumn("belief", F.lit(1.0)), "seeds")
    size = cut(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= seeds), "sizes")  # others can't have enough
    links = cut(edges.select("pattern", "instance").join(size, "pattern"), "links")
    belief, state = seed, None
    for _ in range(rounds):
        weight = links.join(belief, "instance").groupBy("pattern", "kind").agg(F.first("n").alias("n"), F.sum("belief").alias("sum"), F.sum((F.col("belief") >= sure).cast("long")).alias("known"))
        scored = cut(weight.where(F.col("known") >= seeds).select("pattern", "kind", (F.col("sum") / F.col("n")).alias("score")), "scores")
        new = scored.agg(F.count("*"), F.sum(F.round("score", 9))).first()
        if new == state or not new[0]:
            break
        state = new
        unseen = links.join(scored, "pattern").join(seed.select("instance"), "instance", "left_anti").groupBy("instance", "kind").agg(F.max("score").alias("belief"))
        belief = seed.unionByName(cut(unseen, "unseen"))
    return scored.where(F.col("score") >= sure)


def find_private(documents: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, sure: float = SURE) -> DataFrame:
    """doc_id, tid (key of the text), base and more: arrays of (kind, start, end) in order of kind, then start; `more` is what the patterns add."""
    scan = cut(scanned(texts(documents).withColumn("tid", text_name(F.col("text")))), "scan")
    found = cut(occurrences(scan), "occurrences")
    best = patterns(found, rounds, seeds, sure).groupBy("pattern").agg(F.max_by("kind", F.struct("score", "kind")).alias("as"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("as"))
    added = found.where("kind is null").join(best, "pattern").select("doc_id", "tid", F.struct(rank.alias("rank"), "start", "end", F.col("as").alias("kind")).alias("s"))
    added = cut(added.groupBy("doc_id", "tid").agg(F.sort_array(F.collect_set("s")).alias("s")), "added")
    added = added.select(F.col("doc_id").alias("d"), F.col("tid").alias("t"), F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("more"))
    base = F.concat(*[F.transform(k, _named(k)) for k in KINDS])
    joined = scan.join(small(added, *_bytes(added, "more")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")), "left")
    return joined.select("doc_id", "tid", base.alias("base"), F.coalesce("more", F.array().cast("array<struct<kind:string,start:long,end:long>>")).alias("more"))


def _bytes(rows: DataFrame, spans: str) -> tuple[int, int]:
    """Rows, and bytes of a row on average."""
    n, m = rows.agg(F.count("*"), F.sum(F.size(spans))).first()
    return n, 100 + 60 * (m or 0) // max(n, 1)


def in_order(base: Column, more: Column) -> Column:
    rank = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    return F.sort_array(F.transform(F.concat(base, more), rank))


def report(documents: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all).

    documents: doc_id, text (extra columns are ignored). A null text is empty; repeated rows are reported each; where two
    kinds cover the same characters both are; an empty table gives no rows."""
    found = find_private(documents, **options)
    n = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    all_spans = F.when(F.size("more") == 0, written(F.col("base"))).otherwise(written(in_order(F.col("base"), F.col("more"))))
    return found.select("doc_id", *n, F.sha2(written(F.col("base")), 256).alias("base_sha256"), all_spans.alias("spans"))


def redacted(documents: DataFrame, **options) -> DataFrame:
    """documents with every span of `text` replaced by its kind in brackets, n_chars (where there is one) to match.

    A null text stays null; of spans that overlap the first is replaced, and what another has beyond it goes; repeated rows
    stay repeated, each redacted; ids may be null or shared; an empty table gives no rows; all columns are kept."""
    found = find_private(documents.select("doc_id", "text"), **options)
    spans = F.sort_array(F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = found.where(F.size("base") + F.size("more") > 0).select("doc_id", "tid", spans.alias("spans")).dropDuplicates(["doc_id", "tid"])
    found = cut(found, "private")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    text = F.col("row")["text"]
    rows = rows.join(small(found, *_bytes(found, "spans")), F.col("row")["doc_id"].cast("long").eqNullSafe(F.col("doc_id")) & (text_name(F.coalesce(text, F.lit(""))) == F.col("tid")), "left")
    marked = F.col("spans").isNotNull()
    clean = F.when(marked, replaced(text, F.col("spans"), lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).otherwise(text)
    rows = rows.select("row", clean.alias("clean"), marked.alias("marked"))
    changed = {"text": F.col("clean"), "n_chars": F.when(F.col("marked"), F.char_length("clean").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"]) if "n_chars" in documents.columns else None}
    return rows.select(*[(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in documents.columns])
