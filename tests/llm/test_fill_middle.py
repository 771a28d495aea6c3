"""Fill-in-the-middle against plain lines, and chunks against plain places."""

import hashlib
import random
import re

import numpy as np
from brute import SF, sha
from pyspark.sql import functions as F

from cellscope.llm import fill_middle as M


def plain(doc_id, text, fim=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or h[2] % 100 >= fim or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_query_over_whole_table(spark, texts):
    got = M.op11(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, a, b, out = plain(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, a, b)
        assert r.output_sha256 == sha(out) and r.restored_sha256 == sha(texts[r.doc_id] or "")


def test_odd_rows(spark, odd, none):
    more = spark.createDataFrame([(20, "\n"), (21, "\n\n\n"), (22, "x\n<P> y\n"), (23, "<M>"), (24, "<P\n><S\n"), (25, "<\n<\n<"), (26, "a\nb" * 40_000)],
                                 "doc_id bigint, text string")
    df = odd.select("doc_id", "text").unionByName(more)
    for fim, spm in ((100, 50), (40, 0), (100, 100), (0, 50)):
        got = M.fill_in_middle(df, fim_percent=fim, spm_percent=spm).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
        assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str((r.doc_id, *plain(r.doc_id, r.text, fim, spm))) for r in df.collect())
        back = got.select("doc_id", M.restore(F.col("output"), F.col("form")).alias("t"))
        assert sorted(str(tuple(r)) for r in back.collect()) == sorted(str((r.doc_id, r.text or "")) for r in df.collect())
    whole = M.transform_documents(odd)
    assert whole.columns == odd.columns and whole.count() == odd.count()
    row = whole.where("doc_id = 11").first()
    assert row.text == plain(11, odd.where("doc_id = 11").first().text)[4] and row.n_chars == len(row.text)
    assert M.fill_in_middle(none).count() == 0 and M.transform_documents(none).count() == 0


def test_cuts_by_chunks_equal_plain_places():
    rng = random.Random(5)
    cache = M.ChunkCache(1 << 16)
    for size in (0, 1, 15, 16, 17, 400, 9000, 70_000):
        text = "".join(rng.choice("abc é😀\n\n x") for _ in range(size))
        data = np.frombuffer(text.encode(), np.uint8)
        for raw in (data, np.full(size, 97, np.uint8)):
            got = M.Cuts(raw.tobytes(), M.chunk_ends(raw, np.array([0, len(raw)])), cache)
            units = re.findall(r"[^\n]*\n|[^\n]+", raw.tobytes().decode())
            assert got.n == len(units)
            for k in {0, 1, len(units) // 3, len(units) - 1, len(units)} & set(range(len(units) + 1)):
                head = "".join(units[:k])
                assert got.after(k) == (len(head.encode()), len(head))
    assert cache.size <= cache.limit


def test_shared_passages_fall_into_the_same_chunks():
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefghij \n") for _ in range(60_000)).encode()
    cache = M.ChunkCache()

    def run(text):
        data = np.frombuffer(text, np.uint8)
        return list(M.summaries(text, M.chunk_ends(data, np.array([0, len(data)])), cache))
    run(passage)
    first = cache.misses
    run(b"another head " + passage + b" and tail")
    assert cache.misses - first <= 3 and cache.hits >= first - 3
    # a block of several texts gives each the chunks that it has alone
    texts = [b"", passage[:30_000], b"", passage[7_000:], b"x"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    ends = M.chunk_ends(data, offsets)
    for t, a, b in zip(texts, offsets, offsets[1:]):
        alone = M.chunk_ends(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        inside = ends[(ends > a) & (ends < b)] - a
        assert inside.tolist() == [e for e in alone if e < len(t)]
