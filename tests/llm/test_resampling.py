"""Importance resampling against joined runs of words."""

import hashlib
import math
import re
import zlib
from collections import Counter

from brute import SF
from pyspark.sql import functions as F

from cellscope.llm import resampling as R


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def plain(docs, target):
    """[(id, n_features, weight, score, rank)] of (id, text) rows."""
    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, f, _ in found:
        s.update(f)
    for x in target:
        t.update(features(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for i, f, words in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    take = 5 * len(able) // 100
    rank = {id(r): k + 1 for k, r in enumerate(able[:take])}
    return sorted(str((*r[:4], rank.get(id(r)))) for r in rows)


def test_query_over_whole_table(spark, texts):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = plain(list(texts.items()), target)
    assert sorted(str(tuple(r)) for r in R.op12(spark, SF).collect()) == want
    assert sum("None" not in r for r in want) > 0


def test_ranks_with_ties_and_ranges(spark, monkeypatch):
    """Many rows, repeated ids and equal scores: ranks are 1, 2, 3, ... in order."""
    rows = spark.range(5000).select((F.col("id") % 2500).alias("c0"), (F.col("id") % 40).alias("n_words"), (F.col("id") % 37).alias("score"))
    able = sorted(((-r.score, r.c0) for r in rows.collect() if r.n_words >= 20))
    for ranges in (1, 8, 1024):
        monkeypatch.setattr(R, "RANGES", ranges)
        got = R.drawn(rows, "c0").where("rank is not null").orderBy("rank").collect()
        assert [r["rank"] for r in got] == list(range(1, len(able) * 5 // 100 + 1))
        assert [(-r.score, r.c0) for r in got] == able[:len(got)]
    assert R.drawn(rows, "c0").count() == 5000
    everything = R.drawn(rows, "c0", percent=100, min_words=0)
    assert everything.where("rank is null").count() == 0 and everything.agg(F.max("rank")).first()[0] == 5000


def test_odd_rows(spark, odd, none):
    long = spark.createDataFrame([(30 + i, f"Some Words {i} about ÄÖ things_and-more, " * 7) for i in range(60)], "doc_id bigint, text string")
    df = odd.select("doc_id", "text").unionByName(long)
    goal = spark.createDataFrame([("words about things",), (None,), ("",)], "text string")
    want = plain([(r.doc_id, r.text) for r in df.collect()], [r.text for r in goal.collect()])
    got = R.resample(df, goal).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    drawn = R.drawn_documents(odd, goal, percent=100)
    assert drawn.columns == odd.columns and drawn.count() == sum(len(features(r.text)[0]) >= 57 for r in odd.collect())
    assert R.resample(none, goal).count() == 0
    assert R.resample(odd, goal.where("text = 'x'")).count() == odd.count()


def test_pieces_change_nothing():
    text = ("Ünï Code9 a_b-C " * 500 + "z" * 3000 + " end　x " + "B" * 5).encode()
    for limit in (1, 2, 7, 64, 1 << 20):
        codes = Counter()
        words = 0
        for new, found in R.feature_codes(text, limit):
            words += new
            codes.update((found % R.BUCKETS).tolist())
        f, n = features(text.decode())
        assert (codes, words) == (Counter(f), n)
