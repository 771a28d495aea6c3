"""Large groups of near copies: the pairs that are compared stay in proportion to the classes."""

import random

import pytest
from brute import components

from cellscope.llm import jaccard as J


def near_copies(n, seed, words=160):
    """Copies of one text with up to a tenth of its words replaced, most of them by words that
    few copies have, some by words that many have."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(words), rng.choice((1, 1, 2, 3, 4, 5))):
            w[k] = f"n{rng.randrange(10**6)}" if rng.random() < 0.7 else f"c{k}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.fixture
def counted(monkeypatch):
    found = []
    plain = J.compared
    monkeypatch.setattr(J, "compared", lambda texts, pairs: (found.append(pairs.count()), plain(texts, pairs))[1])
    return found


def test_pairs_grow_with_the_classes(spark, counted):
    per_class = []
    for n in (300, 600, 1200):
        counted.clear()
        df = spark.createDataFrame(near_copies(n, 11), "doc_id bigint, text string")
        J.near_duplicates(df).count()
        per_class.append(sum(counted) / n)
    # a token that few classes hold gives up to HOT / 2 pairs a class; what grows with the group does not
    assert max(per_class) < 4 and per_class[2] < 1.5 * per_class[0], per_class


def test_components_of_a_group_equal_brute_force(spark):
    rows = near_copies(260, 12) + [(1000 + i, t) for i, t in near_copies(120, 13, words=60)]
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = components(dict(rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 1 < len({c for _, c in want.values()}) < len(rows)
