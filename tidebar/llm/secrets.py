"""Secret scans over a trigram inverted index.

Each rule's regex yields a Boolean query over trigrams. The index has a row (trigram, document) for each trigram that any
query asks for and each document that holds it; a rule's candidates are the documents that have all trigrams of one of
its clauses. Only candidates are matched against the rule's regex; rules without mandatory trigrams are matched against
every document. DataFrame functions throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import cut, small, text_name, texts
from tidebar.llm.spans import NONE, matches, placed, written
from tidebar.llm.trigrams import query_of


@dataclass(frozen=True)
class Rule:
    """group: the group that is measured, least: its characters at least; base: counted and hashed, others only add spans."""

    name: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def clauses(rules: tuple[Rule, ...] = RULES) -> dict[str, list[frozenset[str]]]:
    """Of each rule that has mandatory trigrams, the clauses of its query."""
    found = {r.name: query_of(r.regex) for r in rules}
    return {k: sorted(q, key=sorted) for k, q in found.items() if q}


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id, tid): the postings of the given trigrams."""
    rows = docs.withColumn("lower", F.lower("text"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("lower"), t))
    return rows.select("doc_id", "tid", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, asked: dict[str, list[frozenset[str]]]) -> DataFrame:
    """doc_id, tid and the rules with a clause whose postings all have the document."""
    spark = postings.sparkSession
    rows = [(rule, i, t, len(c)) for rule, cs in asked.items() for i, c in enumerate(cs) for t in sorted(c)]
    parts = F.broadcast(spark.createDataFrame(rows, "rule string, clause int, trigram string, asked int"))  # a row a trigram of the rules
    hits = postings.join(parts, "trigram").groupBy("doc_id", "tid", "rule", "clause", "asked").agg(F.size(F.collect_set("trigram")).alias("have")).where("have = asked")
    return hits.groupBy("doc_id", "tid").agg(F.collect_set("rule").alias("rules"))


def _spans(rule: Rule, rules: Column) -> Column:
    text, none = F.col("text"), F.array().cast(NONE)
    size = lambda m: F.char_length(m if not rule.group else F.regexp_extract(m, rule.regex, rule.group))
    return F.when(F.size(f"m_{rule.name}") == 0, none).otherwise(F.filter(placed(text, rule.regex, F.col(f"m_{rule.name}")), lambda s: size(s["match"]) >= rule.least)).alias(rule.name)


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and an array of (start, end, match) for each rule."""
    docs = texts(documents).withColumn("tid", text_name(F.col("text")))
    asked = clauses(rules)
    trigrams = sorted({t for cs in asked.values() for c in cs for t in c})
    chosen = cut(candidates(index(docs, trigrams), asked), "candidates") if trigrams else None
    if chosen is None:
        docs = docs.withColumn("rules", F.array().cast("array<string>"))
    else:
        named = chosen.select(F.col("doc_id").alias("d"), F.col("tid").alias("t"), "rules")
        docs = docs.join(small(named, chosen.count(), 120), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")), "left").select("doc_id", "text", F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))
    for r in rules:
        found = matches(F.col("text"), r.regex)
        docs = docs.withColumn(f"m_{r.name}", F.when(F.array_contains("rules", r.name), found).otherwise(F.array().cast("array<string>")) if r.name in asked else found)
    return docs.select("doc_id", *[_spans(r, F.col("rules")) for r in rules])


def _ranked(rank: int, name: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(name).alias("kind"))


def report(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: doc_id, n_<kind> of the base rules, base_sha256, spans (all; by start, then kind).

    documents: doc_id, text (extra columns are ignored). A null text is empty; repeated rows are reported each; kinds may
    overlap; an empty table gives no rows."""
    found = find_secrets(documents, rules)
    ranked = lambda chosen: F.sort_array(F.concat(*[F.transform(r.name, _ranked(i, r.name)) for i, r in enumerate(rules) if chosen(r)]))
    found = found.withColumn("base_spans", ranked(lambda r: r.base)).withColumn("all_spans", ranked(lambda r: True))
    n = [F.size(r.name).cast("long").alias(f"n_{r.name}") for r in rules if r.base]
    return found.select("doc_id", *n, F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("all_spans")).alias("spans"))
