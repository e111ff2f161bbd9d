"""Document fingerprints: bottom-k sketches of hashed word shingles, built and compared with DataFrame functions only.

A fingerprint is the sorted array of a document's k least distinct shingle hashes. Fingerprints of parts merge into that
of the whole; two of them estimate resemblance and containment, one the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import cut, small, texts

SHINGLE = 5
K = 128
#: Bytes of text that a stretch of documents holds, about: the first while there are fewer than FEW stretches, else the second.
STRETCH = (8 << 20, 512 << 20)
FEW = 1000
#: Keys that are sampled to part the stretches evenly, a stretch; and how many are in any case.
SAMPLE = 5
LEAST_SAMPLE = 200_000


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))


def sketch_of(hashes: Column, shingle: int = SHINGLE, k: int = K) -> Column:
    """Fingerprint from the hashes of a text's words; fewer words than a shingle are one shingle, none give an empty array."""
    n = F.size(hashes)
    at = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(shingle)])
    many = F.transform(F.sequence(F.lit(0), n - shingle), at)
    few = F.array(F.xxhash64(F.array_join(F.transform(hashes, lambda h: h.cast("string")), " ")))
    shingles = F.when(n >= shingle, many).when(n > 0, few).otherwise(F.array().cast("array<long>"))
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Fingerprint of two parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of shared shingles among all of both, 0 to 1; two empty texts are alike."""
    both = merged(a, b, k)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + float(2**63)) / float(2**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1."""
    r = resemblance(a, b, k)
    shared = r * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(shared / distinct_shingles(a, k), F.lit(1.0)))


def printed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """doc_id and fingerprint (array of long) of each document: doc_id, text; extra columns are ignored, a null text is empty."""
    rows = texts(documents).withColumn("words", word_hashes(F.col("text")))
    return rows.select("doc_id", sketch_of(F.col("words"), shingle, k).alias("fingerprint"))


def order_key(doc_id: Column, text: Column) -> Column:
    """A string that sorts as (doc_id, the text's SHA-256) does, null ids first."""
    number = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.coalesce(number, F.lit("!")), F.sha2(text, 256))


def _stretch_of(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds aren't above the key, by halving."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(bounds)), ",")  # one literal

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = (s["lo"] < s["hi"]) & (F.get(held, mid) <= key)
        return F.struct(F.when(above, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(above | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, halve, lambda s: s["lo"])


def _in_order(docs: DataFrame, stretch: tuple[int, int]) -> DataFrame:
    """doc_id, text, key, part, head: rows dealt into stretches of consecutive keys; each stretch also gets the row that
    follows it (head = 1), the last one the first row of all.

    A sample of the keys parts the stretches; it decides how even they are, and nothing else."""
    rows = docs.withColumn("key", order_key(F.col("doc_id"), F.col("text")))
    keys = cut(rows.select("key", F.octet_length("text").alias("bytes")), "keys")
    n, size = keys.agg(F.count("*"), F.sum("bytes")).first()
    parts = max(min(FEW, (size or 0) // stretch[0]), (size or 0) // stretch[1], 1)
    bounds: list[str] = []
    if parts > 1:
        share = min(1.0, max(LEAST_SAMPLE, SAMPLE * parts) / n)
        drawn = keys.where(F.pmod(F.xxhash64(F.lit("stretch"), "key"), F.lit(1 << 30)) < share * float(1 << 30)).select(F.substring("key", 1, 24).alias("key"))
        sample = sorted(drawn.toArrow().column("key").to_pylist())  # bounded: see SAMPLE
        bounds = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []
    part = _stretch_of(F.col("key"), bounds)
    first = keys.select("key", part.alias("part")).groupBy("part").agg(F.min("key").alias("first"))
    before = Window.orderBy("part")  # a row a stretch
    first = cut(first.select("first", F.coalesce(F.lag("part").over(before), F.max("part").over(Window.partitionBy())).alias("to")), "heads")
    heads = rows.join(small(first, first.count(), 100), F.col("key") == F.col("first")).dropDuplicates(["key"])
    return rows.select("doc_id", "text", "key", part.alias("part"), F.lit(0).alias("head")).union(heads.select("doc_id", "text", "key", "to", F.lit(1)))


def edited_fingerprints(documents: DataFrame, shingle: int = SHINGLE, k: int = K, stretch: tuple[int, int] = STRETCH) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts: the last half (rounded down) gives way to as many code points
    from the start of the next document's text, or all of it. Next is by ascending doc_id, the first after the last.

    documents: doc_id, text (extra columns are ignored). A null text is empty; a null id comes first; rows with one id
    are ordered by their texts' SHA-256 (rows with one id and one text are sorted in one task); an empty table gives no
    rows; a lone document is its own next. stretch: see STRETCH."""
    rows = _in_order(texts(documents), stretch).repartition("part")
    rows = rows.withColumn("words", word_hashes(F.col("text"))).withColumn("fp", sketch_of(F.col("words"), shingle, k)).drop("words")
    w = Window.partitionBy("part").orderBy("head", "key")
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).where("head = 0")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.drop("text", "next_text").withColumn("words", word_hashes(F.col("edited"))).withColumn("edited_fp", sketch_of(F.col("words"), shingle, k))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("fp")).alias("fingerprint"), printed(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp"), k).alias("near_edited"), resemblance(F.col("fp"), F.col("next_fp"), k).alias("near_next"),
    )
