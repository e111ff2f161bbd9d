"""Bootstrapping, long rules, exact n-gram counts, long logs and clashing columns against plain versions."""

import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidebar.llm import chat, language_id, packing, pii, secrets, simhash_words, spans


def test_contexts_come_from_the_text(spark):
    text = "2024-01-05 12:33:01 user u123 from 10.0.0.1 mail a@b x7 " + "long" * 20 + " z " + "9"
    got = spark.createDataFrame([(text,)], "text string").select(pii.contexts(F.col("text")).alias("c")).first().c
    assert got[:5] == ["^ ^", "^ #-#-#", "#:#:# user", "u# from", "#.#.#.# mail"] and got[5] == "mail @" and re.fullmatch(r"[0-9a-f]{32} z", got[6])


def brute_patterns(rows, rounds, seeds, sure):
    kinds, links = defaultdict(set), defaultdict(set)
    for p, i, k in rows:
        links[p].add(i)
        if k:
            kinds[i].add(k)
    belief = {(i, k): 1.0 for i, ks in kinds.items() for k in ks}
    for _ in range(rounds):
        score = {}
        for p, items in links.items():
            for k in {k for i in items for k in ("email", "phone") if (i, k) in belief}:
                b = [belief.get((i, k), 0.0) for i in items]
                if sum(x >= sure for x in b) >= seeds:
                    score[p, k] = sum(b) / len(b)
        belief = {(i, k): 1.0 for i, ks in kinds.items() for k in ks}
        for (p, k), s in score.items():
            for i in links[p]:
                if i not in kinds:
                    belief[i, k] = max(belief.get((i, k), 0.0), s)
    return {x: s for x, s in score.items() if s >= sure}


def test_bootstrap_against_brute_force(spark):
    r, rows = random.Random(4), []
    for p in range(40):
        for _ in range(r.randint(3, 30)):
            i = r.randrange(10 * (p // 2), 10 * (p // 2) + 40)
            rows.append((f"p{p}", f"i{i}", ("email" if i % 3 else "phone") if i < 120 and i % 7 else None))
    kind = {i: k for _, i, k in rows if k}
    rows = [(p, i, kind.get(i)) for p, i, _ in rows]
    df = spark.createDataFrame(rows, "pattern string, instance string, kind string")
    for rounds in (1, 4):
        got = {(x.pattern, x.kind): x.score for x in pii.patterns(df, rounds, 3, 0.6).collect()}
        want = brute_patterns(rows, rounds, 3, 0.6)
        assert want and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_discovered_instances_admit_new_patterns(spark):
    rows = [f"please contact us: user{i}@mail.example.com now" for i in range(60)] + [f"please contact us: agent{i}x@intranet now" for i in range(12)]
    rows += [f"ticket opened by agent{i}x@intranet today" for i in range(12)] + ["ticket opened by other9@intranet today", "room 12 is free"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii.report(df).collect()}
    assert got[84] == "email:17:32" and got[85] == "" and pii.report(df, rounds=1).where("doc_id = 84").first().spans == ""


def test_redaction_of_many_and_overlapping_spans(spark):
    many = " ".join(f"10.0.{i % 200}.{i % 250}" for i in range(3000))
    data = [(None, many), (None, many), (1, "+1 4111 1111 1111 1111 é"), (1, None), (2, "x" * 5000 + " a@b.cd " + "y" * 9000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("row", F.lit(1))
    got = sorted(((x.doc_id, x.text) for x in pii.redacted(df).collect()), key=str)
    assert got == sorted([(None, " ".join(["[IP]"] * 3000))] * 2 + [(1, got_card(df)), (1, None), (2, "x" * 5000 + " [EMAIL] " + "y" * 9000)], key=str)


def got_card(df):
    text = "+1 4111 1111 1111 1111 é"
    found = [x for x in pii.report(df.where("doc_id = 1 AND text IS NOT NULL")).first().spans.split(",") if x]
    at, out = 0, ""
    for a, b, k in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in found)):
        if a >= at:
            out += text[at:a] + f"[{k.upper()}]"
        at = max(at, b)
    return out + text[at:]


def test_places_in_long_texts(spark):
    text = "".join(random.Random(1).choice(["ab", "é", "1", "22", " "]) for _ in range(60000))
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(spans.placed(F.col("text"), "[0-9]+", spans.matches(F.col("text"), "[0-9]+")).alias("p")).first().p
    assert [(x.start, x.end, x.match) for x in got] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]


def test_rules_of_any_length(spark):
    long = "the quick brown fox jumps over the lazy dog 0123456789 and never comes back again to us"
    df = spark.createDataFrame([(1, f"x {long} y"), (2, long[:-1])], "doc_id long, text string")
    got = {x.doc_id: len(x.long) for x in secrets.find_secrets(df, (*secrets.RULES, secrets.Rule("long", re.escape(long).replace("\\ ", " ")))).collect()}
    assert got == {1: 1, 2: 0}


def grams(t):
    b = language_id._normal(t)
    return [b[i : i + 5] for i in range(len(b) - 4) if b[i : i + 5] != b"     "]


def test_language_counts_against_exact_sets(spark):
    r = random.Random(3)
    vocab = {x: ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(300)] for x, letters in (("aa", "abcdeäö"), ("bb", "cdefghi"), ("cc", "aeioumn"))}
    data = [(i, " ".join(r.choice(vocab[x]) for _ in range(r.randint(1, 60))), x) for i in range(240) for x in [sorted(vocab)[i % 3]]]
    data += [data[0], data[0], (None, "abc abc", "aa"), (None, None, "bb")]  # repeated rows, null ids
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.train(df)
    rows = language_id.sample(df).collect()
    n = defaultdict(lambda: defaultdict(int))
    for x in rows:
        for g in grams(x.text):
            n[x.lang][g] += 1
    exact = {x: {g for g, k in n[x].items() if k >= language_id.LEAST} for x in vocab}
    texts = [t or "" for _, t, _ in data]
    counts, total = model.counts(texts)
    want = np.array([[sum(g in exact[x] for g in grams(t)) for x in model.langs] for t in texts])
    assert total.tolist() == [len(grams(t)) for t in texts]
    assert np.abs(counts - want).mean() <= 0.03 * max(want.mean(), 1) + 0.5
    clear = np.sort(want, axis=1)[:, -1] - np.sort(want, axis=1)[:, -2] > 0.1 * total + 2
    assert clear.sum() > 100 and (counts.argmax(axis=1) == want.argmax(axis=1))[clear].all()
    got = language_id.identify(df).collect()
    assert len(got) == len(data) and not [x for x in got if x.doc_id is None and x.held_out]


def test_long_and_repeated_turns(spark):
    turns = [(1, i, "user", f"t{i % 7}") for i in range(5000)] + [(2, i, "user", f"t{i % 7}") for i in range(4999)] + [(3, 1, "user", "same"), (3, 1, "user", "same"), (4, 1, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(0)).withColumn("kept_id", F.lit(0))
    got = {x.conv_id: x.n_turns for x in chat.format_chats(df).collect()}
    assert got == {1: 5000, 3: 2}


def test_long_texts_are_compared_whole(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(6000)]
    near = base[:5700] + [f"n{i}" for i in range(300)]
    far = base[:3000] + [f"f{i}" for i in range(3000)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((base, near, far))], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in simhash_words.similar_groups(df).collect()} == {0: 0, 1: 0, 2: 2}


def test_stages_with_clashing_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = docs.union(docs.limit(3)).withColumns({c: F.lit("clash") for c in ("row", "kept_id", "name", "n", "spans", "tid", "clean", "marked", "pred", "fit", "copies", "taken_id", "size", "p", "chunk")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, "")
        assert odd.columns[: len(docs.columns)] == docs.columns and odd.count() > 0


def test_ids_of_lines_and_added_tokens():
    rnd, parts = random.Random(1), ["a", "B7", " ", "  ", "\n", "\n\n", "\t", "\r", "é", "日本", " ", "　", "​", "\x85", "\x1c", "<|endoftext|>", "<|", "'s", "!!", "word", "😀", "\x00", "́"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(40))) for _ in range(4000)]
    plain, encoder = packing._tokenizer(packing.TOKENIZER), packing.Encoder()
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], encoder.encode(texts[at : at + 100]), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert encoder.encode([]) == []


def test_units_are_asked_for_without_lines():
    plain, encoder, asked = packing._tokenizer(packing.TOKENIZER), packing.Encoder(), []
    ask = encoder._all
    encoder._all = lambda texts: asked.extend(texts) or ask(texts)
    texts = ["first " + " ".join(f"w{i}\u00e9x line{i}\nnext{i}" for i in range(at, at + 300)) for at in range(0, 900, 300)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(texts) + 1 and sum(t.count("\n") for t in asked) == 900  # one text of units, no line of its own for a unit


def test_words_are_asked_for_once_whatever_mark_follows():
    plain, encoder, asked = packing._tokenizer(packing.TOKENIZER), packing.Encoder(), []
    ask = encoder._all
    encoder._all = lambda texts: asked.extend(texts) or ask(texts)
    marks = ["", ",", ".", "!!", ".\nNext", "'s", "é.", "\nline"]
    texts = ["first " + " ".join(f"wörd{i}é{m}" if i % 2 else f"word{i}x{m}" for i in range(50) for m in marks) for _ in range(3)]
    texts = [f"{text} {k}" for k, text in enumerate(texts)]
    for at in range(3):  # together and one after another
        for text, ids in zip(texts[at:], encoder.encode(texts[at:]), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    said = "".join(asked)
    assert all(said.count(f" wörd{i}é" if i % 2 else f" word{i}x") <= 2 for i in range(50))  # with and without another letter behind
    assert sum(map(len, asked)) < 2500


def test_ids_at_every_pair_of_characters(monkeypatch):
    monkeypatch.setattr(packing, "UNIT", 8)
    monkeypatch.setattr(packing, "UNITS", 300)
    monkeypatch.setattr(packing, "ASKED", 7)
    plain, encoder = packing._tokenizer(packing.TOKENIZER), packing.Encoder()
    odd = [chr(i) for i in (*range(0x100), 0x1680, 0x180E, *range(0x2000, 0x2030), 0x205F, 0x2060, 0x3000, 0xFEFF, 0x301, 0x4F60, 0x1F600)]
    texts = ["b" + "".join(f"{a}{b} x" for b in odd) + a for a in odd] + ["", "a", " ", "\n", "a.", "a<|endoftext|>.b", "　.", ".", "é."]
    for at in range(0, len(texts), 20):
        for text, ids in zip(texts[at : at + 20], encoder.encode(texts[at : at + 20]), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) == len(encoder.ids) <= 300 and max(map(len, encoder.known.to_pylist()), default=0) <= 8
    for text in texts[-9:]:
        assert packing.Encoder().encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
