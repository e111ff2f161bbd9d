"""Language identification with language-bitmask n-gram filters.

One Bloom filter a language would take a look-up a language; here the filters are bit-sliced: slot i holds a word whose
bit l is bit i of language l's filter. The words at an n-gram's slots, and-ed, are the set of languages that contain it.
A text's count for a language is the population count of its bit over the text's n-grams, corrected for the filter's
rate of false positives; the largest count decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import cut, small

N = 5
#: Labelled documents a language that the filters learn from, about (chosen by a hash of the id).
TRAIN_DOCS = 3000
#: Times that an n-gram occurs in a language's sample at least to be in its filter.
LEAST = 2
HASHES = 3
#: Slots of the filters for each n-gram of the language with the most, at least (a fill of 0.3, false positives of 0.03).
SLOTS_EACH = 8
BLOCK = 1 << 19
UNKNOWN = "und"
_SPACE = bytes(32 if chr(i) in "0123456789" or i < 65 or 91 <= i < 97 or 123 <= i < 128 else i for i in range(256))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _normal(text: str) -> bytes:
    return b"  " + text.lower().encode("utf-8", "surrogatepass").translate(_SPACE) + b"  "


def _grams(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram at each position, and whether it lies in one text and isn't all spaces."""
    m = len(data) - N + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    g = np.zeros(m, np.uint64)
    for j in range(N):
        g = (g << np.uint64(8)) | data[j : j + m].astype(np.uint64)
    good = (owner[:m] == owner[N - 1 :]) & (g != np.uint64(int.from_bytes(b" " * N, "big")))
    g = g * np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(32)), good


def _slots(g: np.ndarray, bits: int):
    h = g
    for _ in range(HASHES):
        yield (h >> np.uint64(64 - bits)).astype(np.int64)
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)


def _blocks(texts: list[str | None]):
    """(bytes, owner of each byte) in blocks of bounded size; a long text goes over several, overlapping by N - 1."""
    data, owner, size = [], [], 0
    for i, t in enumerate(texts):
        b = _normal(t) if t else b""
        for at in range(0, len(b), BLOCK):
            part = b[at : at + BLOCK + N - 1]
            data.append(part)
            owner.append((i, len(part)))
            size += len(part)
            if size >= BLOCK:
                yield _joined(data, owner)
                data, owner, size = [], [], 0
    if data:
        yield _joined(data, owner)


def _joined(data, owner):
    ids, lens = zip(*owner)
    return np.frombuffer(b"".join(data), np.uint8), np.repeat(np.array(ids), lens)


def _count(batches):
    for batch in batches:
        langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            mine = [texts[i] for i in np.flatnonzero(langs == lang)]
            for data, owner in _blocks(mine):
                g, good = _grams(data, owner)
                gram, n = np.unique(g[good], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


class Model:
    """langs and words: per 64 languages an array of slots; rate: each language's false positives a look-up."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray]):
        self.langs = langs
        self.bits = max(10, (SLOTS_EACH * max((len(g) for g in grams.values()), default=1)).bit_length())
        self.words = [np.zeros(1 << self.bits, np.uint64) for _ in range(-(-len(langs) // 64))]
        for i, lang in enumerate(langs):
            for at in _slots(grams[lang], self.bits):
                np.bitwise_or.at(self.words[i // 64], at, np.uint64(1 << (i % 64)))
        fill = [float(((self.words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))]
        self.rate = np.array(fill) ** HASHES

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts (texts x languages) and the number of n-grams of each text."""
        hits, total = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for data, owner in _blocks(texts):
            g, good = _grams(data, owner)
            if not len(g):
                continue
            own = owner[: len(g)]
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            who = own[starts]
            np.add.at(total, who, np.add.reduceat(good, starts, dtype=np.int64))
            for w, word in enumerate(self.words):
                found = np.full(len(g), ~np.uint64(0))
                for at in _slots(g, self.bits):
                    found &= word[at]
                found[~good] = 0
                for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                    np.add.at(hits[:, i], who, np.add.reduceat((found >> np.uint64(i % 64)).astype(np.uint8) & 1, starts, dtype=np.int64))
        return np.clip((hits - total[:, None] * self.rate) / (1 - self.rate), 0, None), total


def sample(documents: DataFrame, docs_per_lang: int = TRAIN_DOCS) -> DataFrame:
    """lang and text of about docs_per_lang labelled documents of each language, none of them held out."""
    rows = documents.select(F.col("doc_id").alias("id"), "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = cut(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")  # a row a language
    drawn = F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1 << 30)) < F.least(F.lit(1.0), docs_per_lang / F.col("n")) * float(1 << 30)
    return rows.join(small(counts, counts.count()), "lang").where(drawn).select("lang", "text")


def train(documents: DataFrame, docs_per_lang: int = TRAIN_DOCS, least: int = LEAST) -> Model:
    """Learns from text and non-null lang of documents that aren't held out; about docs_per_lang of each language, all of
    whose n-grams that occur `least` times or more are in its filter."""
    chosen = sample(documents, docs_per_lang)
    seen = cut(chosen.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(r["lang"] for r in seen.select("lang").distinct().collect())  # a row a language
    found = seen.where(F.col("n") >= least).select("lang", "gram").toArrow()  # of a bounded sample
    lang, gram = np.array(found.column("lang").to_pylist(), object), found.column("gram").to_numpy().view(np.uint64)
    return Model(langs, {x: gram[lang == x] for x in langs})


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score (share of the text's n-grams that the language has) to all columns of documents; see identify."""
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    n_kept = len(documents.columns)

    def run(batches):
        m = shared.value
        for batch in batches:  # the columns of documents, then the text and whether it has a letter
            n = batch.num_rows
            pred, score = [UNKNOWN] * n, np.zeros(n)
            if m.langs and n:
                known = np.array(batch.column(n_kept + 1).to_pylist(), bool)
                counts, total = m.counts([t if k else None for t, k in zip(batch.column(n_kept).to_pylist(), known)])
                best = counts.argmax(axis=1)
                top = counts[np.arange(n), best]
                score = np.where(known & (total > 0), np.minimum(top / np.maximum(total, 1), 1.0), 0.0)
                pred = [m.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=names)

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = documents.select("*", F.col("text").alias("id_text"), letter.alias("id_letter"))
    rows = rows.toDF(*[f"c{i}" for i in range(n_kept + 2)])
    schema = documents.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).toDF(*(names := [f"c{i}" for i in range(n_kept)] + ["lang_pred", "score"])).schema
    return rows.mapInArrow(run, schema).toDF(*documents.columns, "lang_pred", "score")


def identify(documents: DataFrame, **sizes: int) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    documents: doc_id, text, lang (extra columns are ignored). lang is read for learning alone. A text that is null or
    has no letter is `und` with score 0; a text with letters but no known n-gram gets the first language and score 0.
    Ties go to the first language by name. Where there is nothing to learn from, every text is `und`; an empty table
    gives no rows; repeated rows are documents of their own; a null id is not held out."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, train(documents, **sizes)).select("doc_id", "held_out", "lang_pred", "score")
