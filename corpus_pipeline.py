"""A training corpus from raw documents, in stages: each stage's rows are written and read again as the next one's documents.

Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import language_id, mixing, packing, pii, simhash_words
from tidebar.llm.common import cut, short_batches, small, text_name

#: Share of n-grams of the predicted language below which a document isn't in any language.
LEAST_SCORE = 0.2


def _row(docs: DataFrame) -> Column:
    """All columns of documents as one, so that no name of theirs clashes with what joins them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages: not those without text or letters (null texts are such), nor those
    that no language's n-grams fit. Repeated rows stay or go alike; an empty table stays empty; where no label is known,
    nothing can be learned and no document is kept."""
    with short_batches(spark):  # rows go to the workers and back with all their columns: hence they are written here
        judged = language_id.predict(docs, language_id.train(docs))
        judged = judged.toDF(*[f"c{i}" for i in range(len(docs.columns))], "pred", "fit")
        kept = judged.where((F.col("pred") != language_id.UNKNOWN) & (F.col("fit") >= LEAST_SCORE))
        kept = cut(kept.drop("pred", "fit"), "judged")
    return kept.toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the least id, then the least name of its text.

    Linked are texts with a similarity of 0.8 or more in five-word shingles, and those whose SimHash differs in three bits
    at most. Ids don't name documents: rows with one id, or none, are one document only if their texts are in one group.
    Null texts are empty, and texts without words one group; an empty table stays empty."""
    groups = simhash_words.similar_groups(docs).groupBy("root", "doc_id", "name").agg(F.count("*").alias("n"))
    least = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name", "n")).alias("k"))
    kept = cut(least.select(F.col("k.doc_id").alias("kept_id"), F.col("k.name").alias("kept_name"), F.col("k.n").alias("n")), "kept")
    n, n_rows = kept.agg(F.count("*"), F.sum("n")).first()
    rows = docs.select(_row(docs))
    rows = rows.select("row", F.col("row")["doc_id"].cast("long").alias("id"), text_name(F.coalesce(F.col("row")["text"], F.lit(""))).alias("name"))
    rows = rows.join(small(kept.drop("n"), n), F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("name") == F.col("kept_name")), "left_semi")
    return (rows if n == (n_rows or 0) else rows.dropDuplicates(["id", "name"])).select("row.*")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; documents without any stay as they are, null texts too. Every row stays, repeated
    ones as well; an empty table stays empty."""
    return pii.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mix of sources asks for: not at all, once or twice. Null texts have no words;
    null sources are one source; repeated rows and null ids are documents of their own; an empty table stays empty."""
    taken = cut(mixing.mix(docs).select(F.col("doc_id").alias("taken_id"), "copies"), "mix")
    n, unique = taken.agg(F.count("*"), F.count_distinct("taken_id")).first()
    if n == unique:
        times = taken.select("taken_id", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
        return docs.select(_row(docs)).join(small(times, 2 * n), F.col("row")["doc_id"].cast("long") == F.col("taken_id")).select("row.*")
    # ids don't name rows: carry the rows along
    rows = cut(mixing.mix(docs.select("doc_id", "source", "text", _row(docs)), keep=("row",)).select("copies", "keep_row"), "mixed")
    return rows.where("copies >= 1").unionAll(rows.where("copies >= 2")).select("keep_row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens. A null text is an end mark alone; repeated rows and null ids are
    documents of their own; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("near-duplicates", near_dedup), ("personal data", private_data), ("mixture", mixture), ("packing", sequences)]

#: The stages learn, hash and draw lots: SQL can't express them; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
