"""Operators that judge rows one by one, against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import SF, joined, luhn, personal, secrets, sha, shingles
from pyspark.sql import functions as F

from cellscope.llm import pii, quality
from cellscope.llm import secrets as S
from cellscope.llm import shingles as G


def spans(rows):
    return sorted((str(r[0]), [tuple(s)[:3] for s in r["spans"]]) for r in rows)


def test_secrets_match_the_contract(spark, texts):
    got = {r.doc_id: r for r in S.op1(spark, SF).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        want = secrets(t)
        assert got[d].base_sha256 == sha(joined(want))
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))


def test_secrets_of_odd_rows(odd, none):
    base = {"assign", "access", "hex"}
    got = [(r.doc_id, [tuple(s) for s in r.spans if s.kind in base]) for r in S.find_secrets(odd).collect()]
    want = [(r.doc_id, secrets(r.text)) for r in odd.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert S.find_secrets(none).count() == 0


def test_postings_lose_no_match():
    """Random texts of rule fragments: scanning candidates equals scanning everything."""
    rng = random.Random(3)
    parts = ["passwd", "PassWord", "api", "_", "key", "token", "'", '"', " ", "=", ":", "AKIA", "ABCDEFGH12345678", "0a1b2c3d4e5f6a7b8c",
             "-----BEGIN ", "RSA PRIVATE KEY-----", "ghp_", "x" * 40, "xoxb-", "1234567890ab", "eyJ", "abcdefghij", ".", "é", "ſ", "K", "\n"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    column = pa.array(rows)
    for a, b, data, offsets in G.text_blocks(column, 3000):
        for i, found in zip(range(a, b), S.scan_block(data, offsets, S.RULES), strict=True):
            want = []
            for k, rule in enumerate(S.RULES):
                for m in S._compiled(S.RULES)[3][k].finditer(rows[i]):
                    if len(m[rule.group]) >= rule.least:
                        want.append((m.start(), k, m.end()))
            assert found == [(S.RULES[k].kind, x, y) for x, k, y in sorted(want)]
            assert [s for s in found if s[0] in S.BASE_KINDS] == secrets(rows[i])


def test_queries_of_patterns():
    assert S.trigram_query("[0-9a-f]+") is None            # scans every row
    assert S.trigram_query("ab") is None
    assert S.trigram_query("a(bc|xy)d") == ("or", frozenset({("and", frozenset({b"abc", b"bcd"})), ("and", frozenset({b"axy", b"xyd"}))}))
    assert S.trigram_query("(abc)?x*") is None
    assert S.trigram_query("(abc)+") == b"abc"


def test_redaction(odd):
    got = S.redact_secrets(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    row = got.where("doc_id = 8").first()
    assert row.text.startswith('[SECRET]" and mail') and row.n_chars == len(row.text)
    assert got.where("doc_id = 1").first().n_chars == odd.where("doc_id = 1").first().n_chars


def test_personal_data_matches_the_contract(spark, texts, odd, none):
    got = {r.doc_id: r for r in pii.op5(spark, SF).collect()}
    for d, t in texts.items():
        assert got[d].base_sha256 == sha(joined(personal(t))), t[:80]
    base = {"email", "ip", "card", "phone"}
    found = [(r.doc_id, [tuple(s)[:3] for s in r.spans if s.kind in base]) for r in pii.find_personal_data(odd).collect()]
    assert sorted(map(str, found)) == sorted(str((r.doc_id, personal(r.text))) for r in odd.collect())
    assert pii.find_personal_data(none).count() == 0


def test_personal_data_of_hard_strings(spark):
    rng = random.Random(5)
    parts = ["1", "23", "4111 1111-1111 1111", ".", "255", "256", "000255", "@", "a", "b.c", "-", " ", "+", "(", ")", "+1 ", "_", "%", "é", "\n", "x@y.z@w.v"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(3000)]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = dict(rows)
    for r in got:
        assert [tuple(s)[:3] for s in r.spans if s.kind in pii_base()] == personal(want[r.doc_id]), want[r.doc_id]


def pii_base():
    return [k.name for k in pii.KINDS if k.base]


def test_checksums_and_context(spark):
    rows = [(1, "IBAN DE89370400440532013000 here"), (2, "IBAN DE89370400440532013001 here"), (3, "my ssn is 123-45-6789."),
            (4, "part 123-45-6789."), (5, "call (212) 555-0199 now"), (6, "see (212) 555-0199 now")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["national_id"], 4: [], 5: ["local_phone"], 6: []}
    nums = ["4111111111111111", "4111111111111112", "79927398713"]
    x = spark.createDataFrame([(n,) for n in nums], "n string").select("n", pii.luhn(F.col("n")).alias("ok")).collect()
    assert all(r.ok == luhn(r.n) for r in x)


def test_prefix_sums(spark):
    from cellscope.llm.common import prefix_sums
    rows = [([random.Random(n).randint(0, 9) for _ in range(n)],) for n in (0, 1, 2, 255, 256, 257, 1000)]
    for r in spark.createDataFrame(rows, "v array<bigint>").select("v", prefix_sums(F.col("v")).alias("p")).collect():
        assert r.p == [sum(r.v[:i]) for i in range(len(r.v))]


@pytest.fixture(scope="module")
def measured(odd):
    return {str(r.doc_id) + str(i): r for i, r in enumerate(quality.quality_report(odd).orderBy("doc_id", "n_words").collect())}


def test_quality_of_odd_rows(measured, odd, none):
    assert len(measured) == odd.count()
    by = {k: r for k, r in measured.items()}
    assert all(not r.kept for r in by.values() if r.n_words < 10)
    long = next(r for r in by.values() if r.doc_id == 9)
    assert (long.n_words, long.n_repeat_words, long.base_failed) == (60_001, 60_000, True)
    kept = quality.clean_documents(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.orderBy("doc_id").collect()] == [1, 1, 2, 3, 8][:len(kept.collect())]
    assert quality.clean_documents(none).count() == 0


def test_lines_that_fail(spark):
    lines = {"A proper sentence that ends well.": False, "Home | News | Sport | Contact": True, "Licensed under the Apache License, Version 2.0.": True,
             "no end mark in this line of words": True, "THIS IS ALL IN CAPITALS!": True, "a### b*** c%%% d&&& e$$$": True, "": False, "Title": False}
    x = spark.createDataFrame([(k,) for k in lines], "l string").select("l", quality.line_fails(F.col("l")).alias("f")).collect()
    assert {r.l: r.f for r in x} == lines


def test_cleaning_takes_effect(spark):
    good = "These are twelve plain words that make up one fine sentence here."
    rows = [(1, good + "\nHome | News | Sport | Contact", 0), (2, "Home | News | Sport | Contact\n" * 9 + good, 0)]
    got = quality.clean_documents(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in got] == [(1, good, len(good))]


def test_shingles_are_those_of_the_contract():
    rng = random.Random(1)
    parts = ["A", "b", "Çd", "dé", "\x0b", " ", "  ", "\n", "\t", " ", "É", "x1", "Z"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["", None]
    seen: dict = {}
    for a, b, data, offsets in G.text_blocks(pa.array(rows), 500):
        for i, s in zip(range(a, b), G.shingle_sets(data, offsets), strict=True):
            want = shingles(rows[i])
            assert len(s) == len(want) and np.all(s[1:] > s[:-1])
            assert seen.setdefault(want, s.tobytes()) == s.tobytes()
    assert len(set(seen.values())) == len(seen)
