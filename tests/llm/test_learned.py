"""Learned operators: language identification and toxicity."""

import random

import numpy as np
from brute import ODD, SF

from cellscope.llm import langid, toxicity

BIG = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang").collect()}
    rows = langid.op6(spark, BIG).collect()
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert len(held) > 200 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and {r.lang_pred for r in rows} <= {*filter(None, lang.values()), "und"}


def test_models_sum_to_one():
    """Interpolated probabilities over all symbols that may follow a history sum to one."""
    import pandas as pd
    rng = random.Random(3)
    data = np.frombuffer("".join(rng.choice("ab cd") for _ in range(4000)).encode(), np.uint8)
    key, _ = langid.grams(*langid.symbols(data, np.array([0, len(data)])))
    found, n = np.unique(key, return_counts=True)
    m = langid.fit(pd.DataFrame({"lang": "xx", "gram": found.view(np.int64), "n": n}))
    seen = np.unique(key & np.uint64(0xFFFF))
    for history in np.unique(key >> np.uint64(16))[:40]:
        total = np.exp(langid.log_probs(m, (history << np.uint64(16)) | seen)[:, 0]).sum()
        assert 0.9 < total < 1.05, total


def test_models_hold_every_gram(spark, monkeypatch):
    """More than 100,000 4-grams of a language, most of them met once, all reach the model."""
    rng = random.Random(5)
    rows = [(i, "".join(chr(0x4E00 + rng.randrange(8000)) for _ in range(3000)), "xx") for i in range(45)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    fitted, fit = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda counts: fitted.append(fit(counts)) or fitted[-1])
    assert langid.identify(df, df, df).where("lang_pred = 'xx'").count() == len(rows)
    assert len(fitted[0]["keys"][-1]) == langid.count_grams(df, "text", "lang").count() > 120_000


def test_languages_of_odd_rows(spark, tables, odd, none):
    rows = langid.op6(spark, tables).collect()
    assert len(rows) == len(ODD)
    text = {r[0]: r[1] for r in ODD}
    for r in rows:
        if r.doc_id is not None and not any(c.isalpha() for c in text[r.doc_id] or ""):
            assert r.lang_pred == "und" and r.score == 0
    assert {r.lang_pred for r in langid.identify(odd, none, none).collect()} == {"und"}
    assert langid.identify(none, odd, odd).count() == 0


def test_marks_without_a_letter_are_no_language(spark):
    known = spark.createDataFrame([(i, "some words of a text", "en") for i in range(9)], "doc_id bigint, text string, lang string")
    texts = ["\u2764\ufe0f", "1\ufe0f\u20e3 2", "\u0301", "e\u0301te\u0301", "a", "\ufe0f 3 \u0301 b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in langid.identify(df, known, known).collect()}
    assert got == {i: (("und", False) if i < 3 else ("en", True)) for i in range(6)}
    data = "e\u0301 \u0301x".encode()
    assert langid.symbols(np.frombuffer(data, np.uint8), np.array([0, 3, len(data)]))[0].tolist() == [ord("e"), 0x301, ord("x")]


def test_rejection_is_monotone():
    score = langid.calibrate({0: (10, 4), 5: (10, 9), 50: (100, 100), 7: (10, 6)})
    assert np.all(np.diff(score) >= -1e-12) and 0 <= score[0] < score[-1] <= 1


def bags(seed=1, n=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(8)) for _ in range(rng.randint(2, 12))]
        toxic = i % 4 == 0
        if toxic:
            lines[rng.randrange(len(lines))] += " " + rng.choice(["vile", "scummy", "odious"])
        out.append((i, ". ".join(lines) + ".", int(toxic)))
    return out


def test_toxic_sentences_are_found(spark):
    rows = bags()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(spark, df.where("doc_id < 400"), "text", "toxic")
    got = toxicity.score(df.where("doc_id >= 400"), model).collect()
    truth = {d: (t, y) for d, t, y in rows}
    assert np.mean([(r.score >= 0.7) == bool(truth[r.doc_id][1]) for r in got]) > 0.97
    for r in got:
        for s in r.sentences:
            assert any(w in truth[r.doc_id][0][s.start:s.end] for w in ("vile", "scummy", "odious"))


def test_long_documents_are_learned_whole(spark):
    """The offending sentence of a long document counts wherever it stands, and length alone is not toxic."""
    rng = random.Random(7)
    rows = []
    for i in range(160):
        lines = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(8)) for _ in range(320)]
        if i % 2:
            lines[rng.randrange(230, 320)] += " vile"
        rows.append((i, ". ".join(lines) + ".", i % 2))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(spark, df.where("doc_id < 120"), "text", "toxic")
    got = toxicity.score(df.where("doc_id >= 120"), model).collect()
    assert np.mean([(r.score >= 0.7) == bool(r.doc_id % 2) for r in got]) > 0.95
    long = [(0, ". ".join(["w1 w2 w3 w4 w5 w6 w7 w8"] * 2000), 0), (1, ". ".join([*["w1 w2 w3"] * 2000, "so vile"]), 1)]
    clean, toxic = sorted(toxicity.score(spark.createDataFrame(long, df.schema), model).collect())
    assert clean.score < 0.7 <= toxic.score and len(toxic.sentences) == 1


def test_word_sets_with_counts_give_the_same_fit():
    rng = random.Random(3)
    kinds = [[], [1], [2, 3], [4]]
    bags = [[kinds[rng.randrange(3)] for _ in range(30)] + ([[4]] if i % 3 == 0 else []) for i in range(60)]
    labels = np.array([int(i % 3 == 0) for i in range(60)])
    sets = [[k for k in kinds if k in bag] for bag in bags]
    one, two = toxicity.fit(bags, labels), toxicity.fit(sets, labels, [[bag.count(k) for k in own] for own, bag in zip(sets, bags, strict=True)])
    assert np.allclose(one[0], two[0], atol=1e-6) and abs(one[1] - two[1]) < 1e-6


def test_toxicity_of_held_out_documents(spark):
    big = "/root/testdata/sf0.1"
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = toxicity.op10(spark, big).collect()
    held = [(r.score, y[r.doc_id]) for r in rows if r.held_out and y.get(r.doc_id) is not None]
    pos, neg = [s for s, v in held if v], [s for s, v in held if not v]
    auc = np.mean([np.mean([(p > n) + 0.5 * (p == n) for n in neg]) for p in pos])
    assert auc > 0.88
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_of_odd_rows(spark, tables, none):
    rows = toxicity.op10(spark, tables).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, (np.zeros(1 << toxicity.BITS), -1.0)).count() == 0
    weight, bias = toxicity.fit([], np.zeros(0, int))
    assert not weight.any() and bias == -np.inf
    only = toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), (weight, bias))
    assert only.where("score != 0").count() == 0
