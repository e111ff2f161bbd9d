"""Similar groups and the pipeline's stages against plain versions."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidebar.llm import common, language_id, packing, pii, simhash, simhash_words

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = t.split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copies():
    r = random.Random(11)
    vocab = ["w%d" % i for i in range(4000)]
    out = [" ".join(r.choice(vocab) for _ in range(r.randint(80, 400))) for _ in range(60)]
    for t in list(out[:30]):
        for _ in range(3):
            w = t.split()
            for i in r.sample(range(len(w)), max(1, len(w) // 60)):
                w[i] = r.choice(vocab)
            out.append(" ".join(w))
    base = [r.choice(vocab) for _ in range(300)]
    out += [" ".join(base[:i] + ["changed%d" % i] + base[i + 1 :]) for i in range(0, 300, 3)]  # a large group of near copies
    return [*out, out[0], out[0], "", None, "one two", "one two"]


@pytest.mark.parametrize("tile", [1024, 7])
def test_similar_groups(spark, tile):
    data = list(enumerate(near_copies()))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("tid", F.lit("clash"))
    got = {r.doc_id: r.component_id for r in simhash_words.similar_groups(df, tile=tile).collect()}
    sets = [shingles(t or "") for _, t in data]
    fps = [simhash.fingerprint(t or "") for _, t in data]
    label = list(range(len(data)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) >= 0.8 * union or bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    want = {i: find(i) for i in range(len(data))}
    missed = sum(got[i] != want[i] for i in want)
    assert all(want[c] == want[i] for i, c in got.items())  # no group too large
    assert missed <= 0.02 * len(data)


def groups(data, linked):
    label = list(range(len(data)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in range(len(data))}


def similar(data):
    sets, fps = [shingles(t) for t in data], [simhash.fingerprint(t) for t in data]
    return groups(data, lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (fps[i] ^ fps[j]).bit_count() <= 3)


def found(spark, data, **sizes):
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash_words.similar_groups(df, **sizes).collect()}


@pytest.mark.parametrize("tile", [1024, 7])
def test_cut_appended_and_spliced_copies(spark, tile):
    r = random.Random(5)
    vocab = ["w%d" % i for i in range(20000)]
    data, notice = [], [r.choice(vocab) for _ in range(30)]
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(60, 500))]
        w = notice + w if i % 3 == 0 else w  # a passage that many texts have
        data.append(" ".join(w))
        extra = [r.choice(vocab) for _ in range(len(w))]
        for share in (0.12, 0.17, 0.19, 0.21):
            n = int(share * len(w))
            data += [" ".join(w[: len(w) - n]), " ".join(w + extra[: int(n / (1 - share))]), " ".join(w[: len(w) // 2] + extra[: n // 2] + w[len(w) // 2 :])]
    data += [" ".join(notice[i : i + 20]) for i in range(8)] * 2  # texts of frequent shingles only
    assert found(spark, data, tile=tile) == similar(data)


@pytest.mark.parametrize("tile", [1024, 7])
def test_copies_of_records_with_the_same_words(spark, tile):
    r = random.Random(6)
    words, data = ["w%d" % i for i in range(120)], []
    for k in range(100):
        w = r.sample(words, len(words))
        data.append(" ".join(w))
        w[30], w[80] = "a%d" % k, "b%d" % k
        data.append(" ".join(w))
    got = found(spark, data, tile=tile)
    assert got == similar(data) and all(got[i] == got[i + 1] for i in range(0, len(data), 2))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    language, dedup, private, mixture, packed = (f for _, f in corpus_pipeline.STAGES)
    a = language(spark, docs, SF)
    assert a.columns == cols and a.count() >= 0.99 * docs.count()
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).union(docs.limit(2).withColumn("text", F.lit("12 34")))
    assert language(spark, docs.union(odd), SF).count() == a.count()
    b = dedup(spark, docs.union(docs.limit(5)), SF)
    assert b.columns == cols and b.count() == b.select("doc_id").distinct().count() == b.select("text").distinct().count()
    c = private(spark, b, SF)
    assert c.columns == cols and c.count() == b.count()
    left = pii.report(c).agg(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone"))).first()[0]
    assert left == 0
    clean = pii.report(b).where("spans = ''").select("doc_id")
    before = {tuple(r) for r in b.join(clean, "doc_id", "left_semi").select(cols).collect()}
    assert before <= {tuple(r) for r in c.collect()}
    d = mixture(spark, c, SF)
    assert d.columns == cols and d.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    e = packed(spark, d, SF)
    assert e.select("doc_id").distinct().count() == d.select("doc_id").distinct().count()
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SF).count() == 0


def test_near_duplicates_keep_texts_that_share_an_id(spark):
    r = random.Random(7)
    a, b, c, d = (" ".join(r.choice("abcdefgh") + str(r.randint(0, 9999)) for _ in range(80)) for _ in range(4))
    data = [(None, a), (None, b), (7, c), (7, d), (8, d + " more"), (7, c), (9, a), (None, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = [tuple(x) for x in corpus_pipeline.near_dedup(spark, df, SF).collect()]
    assert sorted(got, key=str) == sorted([(9, a), (None, b), (7, c), (7, d), (None, "")], key=str)


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    again = corpus_pipeline.run(spark, SF)
    assert got.count() == again.count() > 0
    assert got.agg(F.sum("length"), F.sum("ids_crc32")).first() == again.agg(F.sum("length"), F.sum("ids_crc32")).first()


def test_sample_is_counted_without_a_row_a_shingle(spark):
    texts = [t or "" for t in near_copies()]
    sets = [simhash_words.shingle_set(t.encode()) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["tid", "text"])
    total = sum(map(len, sets))
    runs = list(simhash_words._runs(5, 20_000)([batch.slice(at, 50) for at in range(0, len(texts), 50)]))
    assert total > 60_000 and sum(b.num_rows for b in runs) <= (total // 20_000 + 1) * simhash_words.PARTS
    assert sum(len(x.as_py()) for b in runs for x in b.column("run")) == 8 * total
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = simhash_words.keyed(df).dropDuplicates(["tid"])
    nodes = docs.select("tid", F.col("doc_id").alias("first"))
    want = Counter(s for t in set(texts) for s in simhash_words.shingle_set(t.encode()).tolist())
    want = {s: n for s, n in want.items() if n > 1}
    s, n = simhash_words._frequent(docs, nodes, len(set(texts)), 5)
    assert dict(zip(s.tolist(), n.tolist())) == want and (s[1:] > s[:-1]).all()
    parts = sorted((p, x) for b in runs for p, x in zip(b.column("part").to_pylist(), b.column("run").to_pylist()))
    parts = pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["part", "run"])
    cuts = list(simhash_words._recurrent([parts.slice(at, 7) for at in range(0, parts.num_rows, 7)]))
    every = Counter(s for x in sets for s in x.tolist())
    assert {s % 2**64: n for b in cuts for s, n in zip(b.column("s").to_pylist(), b.column("n").to_pylist())} == {s: n for s, n in every.items() if n > 1}
    assert not list(simhash_words._runs(5)([])) and not list(simhash_words._recurrent([]))


def test_texts_go_to_workers_in_short_batches(spark, monkeypatch):
    key, seen, size = "spark.sql.execution.arrow.maxBytesPerBatch", {}, common.BATCH_BYTES
    before = spark.conf.get(key)

    def noted(df, name, cut=common.cut):
        seen.setdefault(name, set()).add(spark.conf.get(key))
        return cut(df, name)

    monkeypatch.setattr(simhash_words, "cut", noted)
    monkeypatch.setattr(packing, "cut", noted)
    df = spark.createDataFrame([(i, f"{i % 7} some words that come again") for i in range(20)], "doc_id long, text string")
    simhash_words.similar_groups(df).collect()
    packing.pack(df).collect()
    assert all(seen[name] == {str(size)} for name in ("fingerprints", "recurring", "near", "alike", "pieces")) and spark.conf.get(key) == before

    def lengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    long = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("a"), 5000).alias("text"))
    with common.short_batches(spark):
        rows = [r.n for r in long.mapInArrow(lengths, "n long").collect()]
    assert sum(rows) == 4000 and max(rows) <= 2 * size / 5000
    with pytest.raises(ZeroDivisionError), common.short_batches(spark):
        1 / 0
    assert spark.conf.get(key) == before


def test_workers_give_memory_back_when_a_task_is_over(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    task = common.lean(lambda batches: (2 * b for b in batches))
    assert list(task(iter([1, 2]))) == [2, 4] and len(calls) == 1
    left = task(iter([1, 2]))
    next(left)
    left.close()
    assert len(calls) == 2


def test_rows_are_judged_in_short_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", {}
    before = spark.conf.get(key)

    def noted(df, name, cut=common.cut):
        seen[name] = spark.conf.get(key)
        return cut(df, name)

    monkeypatch.setattr(corpus_pipeline, "cut", noted)
    monkeypatch.setattr(language_id, "cut", noted)
    rows = [(i, w, "text " * (i % 3) + w, x) for i, (w, x) in enumerate([("hello there", "en"), ("guten tag", "de")] * 10)]
    df = spark.createDataFrame([*rows, (None, None, None, None)], "doc_id long, `a.b` string, text string, lang string")
    got = corpus_pipeline.language(spark, df, SF)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} <= set(rows)
    assert seen["judged"] == seen["grams"] == str(common.BATCH_BYTES) and spark.conf.get(key) == before
