"""Operators over many rows: joins, packing, mixing, chat windows, fingerprints."""

import json
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from brute import ODD, SF, components, sha, words
from pyspark.sql import functions as F

from cellscope.llm import chat, fingerprints, jaccard, mixing, packing, quality
from cellscope.llm.components import connected
from cellscope.llm.tokens import BlockTokenizer


@pytest.mark.parametrize("name,run,sql", [("op2", chat.op2, chat.SQL), ("op8", quality.op8, quality.SQL)])
def test_oracles(spark, name, run, sql):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = run(spark, SF).toPandas()
    want = con.sql(sql).df()[list(got.columns)]
    key = list(got.columns)
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.v: r.component for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    touched = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: root(v) for v in touched}


def near_copies(seed, n, size, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(size)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


def crowded(seed=4):
    """Groups of near copies, a passage shared by many documents, and documents made of passages."""
    rng = random.Random(seed)
    rows = near_copies(1, 40, 80, 4) + near_copies(2, 12, 200, 9) + near_copies(3, 30, 30, 2)
    passages = [" ".join(f"p{i}x{j}" for j in range(25)) for i in range(6)]
    rows += [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(40)) + " " + passages[0] for _ in range(30)]
    rows += [" ".join(rng.sample(passages, 4)) for _ in range(40)]
    rows += [" ".join(passages[:k]) for k in (1, 2, 3, 4, 5, 6)] + [rows[0]] * 5 + ["a b", "A B", "a b c d e", "", None]
    rng.shuffle(rows)
    return dict(enumerate(rows))


@pytest.mark.parametrize("hot", [2, 32])
def test_join_finds_each_link(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    texts = crowded()
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == components(texts)


def test_join_of_the_small_table(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op4(spark, SF).collect()}
    assert got == components(texts)


def test_join_of_odd_rows(odd, none):
    got = Counter((r.doc_id, r.component_id) for r in jaccard.near_duplicates(odd).collect())
    assert got[(1, 1)] == 2 and got[(2, 1)] == 1 and got[(3, 1)] == 1 and got[(None, None)] == 2 and sum(got.values()) == len(ODD)
    stay = [r.doc_id for r in jaccard.first_of_each(odd).collect()]
    assert sorted(d for d in stay if d is not None) == [1, 4, 5, 6, 7, 8, 9, 10, 11] and stay.count(None) == 2
    assert jaccard.first_of_each(odd).columns == odd.columns
    assert jaccard.near_duplicates(none).count() == 0


def test_bound_of_the_prefix_counts():
    """Linked sets share more emitted tokens than a class may have hot ones and still be safe."""
    for n in range(4, 3000):
        for m in range((4 * n + 4) // 5, n * 5 // 4 + 1):
            shared = min(jaccard.emitted(n) - n, jaccard.emitted(m) - m) + jaccard.overlap(n, m)
            assert shared >= min(jaccard.slack(n), jaccard.emitted(n) - 1), (n, m)
            if m > n + 40:
                break


def pieces_of(df):
    return packing.pack(df, packing.default_tokenizer())


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    rows = pieces_of(odd).collect()
    got: dict = {}
    fill: dict = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= 1024
        got.setdefault((r.doc_id, r.doc_tokens), Counter())[(r.start, bytes(r.ids))] += 1
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    want: dict = {}
    for r in ODD:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault((r[0], len(ids)), Counter())[ids.tobytes()] += 1
    for key, docs in want.items():
        whole = sum((np.frombuffer(b, "<u4").astype(np.uint64).sum() * n for b, n in docs.items()), np.uint64(0))
        parts = sum((np.frombuffer(b, "<u4").astype(np.uint64).sum() * n for (_, b), n in got[key].items()), np.uint64(0))
        assert whole == parts and sum(len(b) * n for b, n in docs.items()) == sum(len(b) * n for (_, b), n in got[key].items())
    assert pieces_of(none).count() == 0


def test_packing_of_the_table(spark, texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    rows = packing.op3(spark, SF).collect()
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for d, x in texts.items()}
    seen = Counter()
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += len(part)
    assert seen == {d: len(x) for d, x in ids.items()}
    used = sum(seen.values())
    assert 1024 * len({r.sequence_id for r in rows}) < 1.03 * used


def test_differencing_is_near_equal():
    rng = random.Random(9)
    sizes = [rng.randint(1, 256) for _ in range(800)]
    k = -(-sum(sizes) // 1024)
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, k)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 0.05 * max(sums)
    dealt = packing.deal(sizes)
    assert sorted(i for w in dealt for i in w) == list(range(800)) and max(sum(sizes[i] for i in w) for w in dealt) <= 1024
    assert packing.deal([1024, 1024, 1]) and len(packing.deal([1000, 1000])) == 2


def test_tokens_of_hard_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from cellscope.llm.shingles import text_blocks
    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    rng = random.Random(1)
    parts = ["a", "b", "'", "s", "t", "re", "'s", "'ll", " ", "  ", "\n", "\t", "1", "23", "!", "?,", "é", "漢字", " ", "😀", "'ve", "I'm", "don't",
             "<|endoftext|>", "\r\n", " ", "٣", "x"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [None, ""]
    mine = BlockTokenizer(packing.default_tokenizer())
    for a, b, data, offsets in text_blocks(pa.array(rows), 2000):
        ids, ends = mine.encode(data, offsets, 0)
        for i in range(a, b):
            assert ids[ends[i - a]:ends[i - a + 1]].tolist() == [*t.encode(rows[i] or "", add_special_tokens=False).ids, 0]


def test_added_tokens_are_read_as_such(spark):
    """As the tokenizer does at its defaults, also beside white space and over the bounds of texts."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from cellscope.llm.shingles import text_blocks
    t = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "I'm", "é", "12", "<", "|>", "😀"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)] + ["a <|endof", "text|> b"]
    mine = BlockTokenizer(packing.default_tokenizer(), added=True)
    want = [[*t.encode(x, add_special_tokens=False).ids, 0] for x in rows]
    for a, b, data, offsets in text_blocks(pa.array(rows), 2000):
        ids, ends = mine.encode(data, offsets, 0)
        for i in range(a, b):
            assert ids[ends[i - a]:ends[i - a + 1]].tolist() == want[i], rows[i]
    text = "one <|endoftext|> two"
    got = pieces_of(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert got[0].doc_tokens == len(t.encode(text, add_special_tokens=False).ids) + 1


def plain_targets(sizes):
    """Water filling, one source at a time. sizes: source -> words."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    held: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in held)
        free = sum(weight[s] for s in names if s not in held)
        target = {s: 3 * sizes[s] if s in held else rest * weight[s] / free for s in names}
        more = {s for s in names if s not in held and target[s] > 3 * sizes[s]}
        if not more:
            return target
        held |= more


def test_mixing(spark, texts):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = mixing.op7(spark, SF).collect()
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((d, len(words(t))) for d, t in texts.items())
    sizes: Counter = Counter()
    taken: Counter = Counter()
    largest: Counter = Counter()
    for r in rows:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
        assert 0 <= r.taken <= 3 * r.size
    target = plain_targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-3
    for s in sizes:
        assert target[s] - largest[s] <= taken[s] <= target[s] + 1e-6, s
    assert abs(sum(taken.values()) / sum(sizes.values()) - 1) < 0.02
    again = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    assert {r.id: r.copies * r.size for r in mixing.mix(again).collect()} == {r.doc_id: r.taken for r in rows}


def test_mixing_caps_and_odd_rows(spark, odd, none):
    rows = [(i, "w " * 100, "big") for i in range(50)] + [(90, "w " * 10, "small"), (91, "w " * 10, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    per = {s: sum(r.copies * r.size for r in got if r.source == s) for s in ("big", "small", None)}
    assert per["small"] == 30 and per[None] == 30 and 4860 <= per["big"] <= 4960
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    assert mixing.mix(odd).agg(F.sum("rows")).first()[0] == len(ODD)
    assert mixing.mix(none).count() == 0 and mixing.mix_documents(none).count() == 0


def missing(got, s):
    """Words that source s is short of its target, and the sizes of its documents that could be taken once more."""
    own = [r for r in got if r.source == s]
    certain = int(own[0].target // own[0].source_size)
    return own[0].target - sum(r.copies * r.size * r.rows for r in own), [r.size for r in own if r.size and r.copies == certain]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mixing_goes_on_after_a_large_document(spark, seed):
    """Nothing that would still fit is left out, whatever the size of what did not fit."""
    rows = [(seed * 10**6 + i, "w " * (1 + i % 9), "a") for i in range(900)] + [(seed * 10**6 + 900 + k, "w " * 2250, "a") for k in range(2)]
    rows += [(seed * 10**6 + 2000 + i, "w " * 5, "b") for i in range(2400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for s in ("a", "b"):
        gap, left = missing(got, s)
        assert 0 <= gap and (not left or gap < min(left)), (s, gap)


def test_rows_that_are_alike_are_sampled_one_by_one(spark):
    rows = [(1, "w " * 10, "a")] * 500 + [(2 + i, "w " * 10, "b") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("n", F.monotonically_increasing_id())
    got = mixing.mix(df).collect()
    assert all(missing(got, s)[0] < 10 for s in ("a", "b")) and sum(r.rows for r in got) == 600
    kept = Counter(r.n for r in mixing.mix_documents(df).where("source = 'a'").collect())
    assert sum(kept.values()) == sum(r.rows * r.copies for r in got if r.source == "a") and max(kept.values()) - min(kept.values()) <= 1


def test_marks_in_sources_keep_rows_apart(spark):
    rows = [(1, "x|y", "z b"), (1, "x", "y|z b"), (1, "x\\", "y|w"), (1, "x\\|y", "w"), (1, "", "|w"), (1, "|", "w"), (1, None, "=|w"),
            (None, "=1|a", "w")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, text string"))
    assert got.agg(F.countDistinct("key"), F.sum("rows")).first() == (len(rows), len(rows))
    assert {(r.source, r.source_size) for r in got.collect()} == {
        (s, sum(len((t or "").split()) for _, x, t in rows if x == s)) for _, s, _ in rows}


def test_pareto_ranks_follow_the_sizes(spark):
    """Long documents are sampled more often than short ones of the same source."""
    rows = [(i, "w " * (400 if i % 2 else 25), "s" if i < 1500 else "t") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("source = 's'").collect()
    share = {n: sum(r.copies > 0 for r in got if r.size == n) / 750 for n in (400, 25)}
    assert 0 < share[25] < share[400] < 1


def test_chat_windows(spark):
    rng = random.Random(6)
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 60)):
            role = "system" if t == 0 and c % 2 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, " ".join(rng.choice(["word", "\\", "<|end|>", "<|turn|>", "<", "|", "é"]) for _ in range(rng.randint(0, 14)))))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    got = chat.read_back(chat.windows(df, budget=300, history=60)).orderBy("conv_id", "window").collect()
    for c in range(12):
        own = [r for r in got if r.conv_id == c]
        assert [(t.role, t.text) for r in own for t in r.turns] == [(r[2], r[3]) for r in rows if r[0] == c]
        assert [t for r in own for t in r.targets] == [r[3] for r in rows if r[0] == c and r[2] == "assistant"]
        for r in own[1:]:
            assert (c % 2 == 0) or r.formatted.startswith("<|turn|>system<|text|>")
    assert max(r.n_repeated for r in got) > 1 and len(got) > 12
    size = spark.createDataFrame([(r.formatted,) for r in got], "f string") \
        .select(chat.tokens(F.lit(""), chat.unescape(F.regexp_replace("f", r"<\|(turn|text|end)\|>", " "))).alias("n"))
    assert size.agg(F.max("n")).first()[0] <= 300


def test_chat_budget_with_long_turns(spark):
    """A window exceeds the budget only where one turn and the system turn do by themselves."""
    rng = random.Random(14)
    sizes = {0: [80] * 8 + [700] + [80] * 5, 1: [900, 20, 1010, 1015, 5, 5, 600, 500, 400], 2: [1500, 30, 30, 2000, 1],
             3: [rng.choice([1, 9, 90, 300, 640]) for _ in range(80)], 4: [rng.randint(1, 1000) for _ in range(60)], 5: [700, 5],
             6: [rng.randint(1, 120) for _ in range(150)]}
    system = {1: 0, 3: 200, 4: 560, 5: 1100}
    rows = []
    for c, ns in sizes.items():
        first = [("system", system[c])] if c in system else []
        rows += [(c, i, r, " ".join(["a"] * n)) for i, (r, n) in enumerate(first + [(["user", "assistant"][i % 2], n) for i, n in enumerate(ns)])]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = chat.read_back(chat.windows(df)).orderBy("conv_id", "window").collect()
    cost = lambda role, text: len(text.split()) + (2 if role == "assistant" else 1) + 4
    for c in sizes:
        own = [r for r in got if r.conv_id == c]
        turns = [(r[2], r[3]) for r in rows if r[0] == c]
        assert [(t.role, t.text) for r in own for t in r.turns] == turns
        head = [turns[0]] if c in system else []
        seen = 0
        for k, r in enumerate(own):
            again = r.n_repeated - (len(head) if k else 0)
            held = (head if k else []) + turns[seen - again:seen] + [(t.role, t.text) for t in r.turns]
            assert r.formatted == "".join(f"<|turn|>{a}<|text|>{b}<|end|>" for a, b in held)
            assert sum(cost(*t) for t in turns[seen - again:seen]) <= chat.HISTORY
            fresh = [t for t in r.turns if t.role != "system"]
            assert sum(cost(*t) for t in held) <= chat.BUDGET or (len(fresh) == 1 and sum(cost(*t) for t in head) + cost(*fresh[0]) > chat.BUDGET)
            seen += len(r.turns)
    assert sum(r.n_repeated > 1 for r in got if r.conv_id == 6) > 5


def test_chat_of_odd_rows(spark, tables):
    got = {r.conv_id: r for r in chat.op2(spark, tables).collect()}
    text = r"\### Assistant: </turn> ok"
    assert got[-7].turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n") and got[-7].loss_sha256 == sha(text)
    assert got[1].turns_sha256 == sha("system\nbe <|end|> kind\n\ntie\nuser\n\nassistant\na\\|b<\n") and got[1].loss_chars == 5
    assert (got[2].n_turns, got[2].loss_sha256) == (2, sha("onlyonly")) and got[None].n_turns == 1
    none = spark.read.parquet(f"{tables}/conversations.parquet").where("turn = -1")
    assert chat.windows(none).count() == 0


def plain_anchors(text):
    return {h: int(at) for h, at in (a.split("@") for a in text.split(",") if a)}


def plain_likeness(a, b):
    if a == b:
        return 1.0
    shifts = sorted(b[h] - a[h] for h in a.keys() & b.keys())
    if not shifts:
        return 0.0
    mid = shifts[len(shifts) // 2]
    j = sum(abs(s - mid) <= fingerprints.SLACK for s in shifts) / (len(a) + len(b) - len(shifts))
    return 2 * j / (1 + j)


def test_fingerprints_of_the_table(spark, texts):
    got = {r.doc_id: r for r in fingerprints.op9(spark, SF).collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        text, after = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(text) // 2
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == sha(text[:len(text) - half] + after[:half])
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
        # the returned fingerprints are those whose likeness is returned
        own, edited, follows = (plain_anchors(x) for x in (got[d].fingerprint, got[d].edited_fingerprint, got[order[(i + 1) % len(order)]].fingerprint))
        assert abs(got[d].near_edited - plain_likeness(own, edited)) < 1e-6
        assert abs(got[d].near_next - plain_likeness(own, follows)) < 1e-6
    long = [r for r in got.values() if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.35 > 0.1 > np.mean([r.near_next for r in long])
    by_text: dict = {}
    for d, t in texts.items():
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def test_next_rows_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PER_RANGE", 7)
    rng = random.Random(8)
    ids = rng.sample(range(-10**15, 10**15), 200)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(df, "doc_id", ["text"], "text", 200).collect()}
    order = sorted(ids, reverse=True)
    assert got == {d: str(order[(i + 1) % 200]) for i, d in enumerate(order)}


def test_anchors_are_closed_syncmers(spark):
    """Chosen by a plain reading of the definition, and free of context."""
    rng = random.Random(11)
    text = " ".join(f"t{rng.randint(0, 999)}" for _ in range(120))
    w = text.split()
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(w, w[1:], strict=False))], "i int, a string, b string") \
        .select("i", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("g")).collect()
    g = [r.g for r in sorted(pairs)]
    size = fingerprints.K - fingerprints.S + 1
    want = {i + 1 for i in range(len(w) - fingerprints.K + 1) if min(g[i:i + size]) in (g[i], g[i + size - 1])}
    df = spark.createDataFrame([(1, text), (2, "zz yy xx " + text)], "doc_id bigint, text string")
    got = {r.doc_id: {(a.h, a.at) for a in r.anchors} for r in fingerprints.fingerprints(df).collect()}
    assert {at for _, at in got[1]} == want
    assert {(h, at + 3) for h, at in got[1]} <= got[2]


def test_long_documents_keep_all_anchors(spark):
    """A passage of 60 words that two documents of 6,000 words share gives common anchors, at one shift."""
    rng = random.Random(13)
    word = lambda: f"t{rng.randint(0, 10**6)}"
    passage = [word() for _ in range(60)]
    long = [[word() for _ in range(6000)] for _ in range(2)]
    texts = [" ".join(long[0][:2000] + passage + long[0][2000:]), " ".join(long[1][:4500] + passage + long[1][4500:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    a, b = ({x.h: x.at for x in r.anchors} for r in sorted(fingerprints.fingerprints(df).collect()))
    assert min(len(a), len(b)) > 1500
    common = set(a) & set(b)
    assert len(common) > 10 and {b[h] - a[h] for h in common} == {2500}
    want = 2 * len(common) / (len(a) + len(b))
    x = fingerprints.anchors_of(fingerprints.anchors_of(df, F.col("text"), "a"), F.lit(texts[1]), "b")
    got = [r.n for r in x.orderBy("doc_id").select(fingerprints.likeness(F.col("a"), F.col("b")).alias("n")).collect()]
    assert abs(got[0] - want) < 1e-9 and got[1] == 1.0


def test_fingerprints_of_odd_rows(spark, tables, none):
    rows = fingerprints.op9(spark, tables).collect()
    assert len(rows) == len(ODD)
    assert all(r.fingerprint == "" for r in rows if r.n_chars == 0)
    assert json.dumps([r.near_next for r in rows]) and fingerprints.fingerprints(none).count() == 0
