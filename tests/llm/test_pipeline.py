"""The pipeline, stage by stage, against plain versions."""

from collections import Counter

import pytest
from brute import SF, components, secrets, words
from test_groups import plain_targets

import corpus_pipeline as P


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["input"] = docs
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        f(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_keep_the_columns(stages):
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "near_duplicates", "secrets", "mix", "pack"]
    assert all(stages[n].columns == stages["input"].columns for n in names[:-1])


def test_rejected_documents_go(spark, stages):
    from cellscope.llm.quality import op8
    kept = {r.doc_id for r in op8(spark, SF).collect() if r.kept}  # a filter would be pushed below the measures
    assert {r.doc_id for r in stages["quality"].collect()} == kept
    assert all(len(r.text) == r.n_chars for r in stages["quality"].collect())


def test_one_of_each_group_stays(stages):
    before = {r.doc_id: r.text for r in stages["quality"].collect()}
    least = {c for _, c in components(before).values()}
    assert Counter(r.doc_id for r in stages["near_duplicates"].collect()) == Counter(least)


def test_no_secret_is_left(stages):
    before = {r.doc_id: r.text for r in stages["near_duplicates"].collect()}
    after = {r.doc_id: r.text for r in stages["secrets"].collect()}
    assert set(before) == set(after) and not any(secrets(t) for t in after.values())
    assert all(after[d] == t for d, t in before.items() if not secrets(t))


def test_mix_meets_the_targets(stages):
    before = stages["secrets"].collect()
    size = {r.doc_id: len(words(r.text)) for r in before}
    source = {r.doc_id: r.source for r in before}
    total: Counter = Counter()
    for d, n in size.items():
        total[source[d]] += n
    taken: Counter = Counter()
    copies = Counter(r.doc_id for r in stages["mix"].collect())
    for d, n in copies.items():
        taken[source[d]] += n * size[d]
    target = plain_targets(dict(total))
    assert max(copies.values()) <= 3
    for s in total:
        assert target[s] - max(size[d] for d in size if source[d] == s) <= taken[s] <= target[s] + 1e-6


def test_pieces_cover_the_mix(stages):
    docs = Counter(r.doc_id for r in stages["mix"].collect())
    got: Counter = Counter()
    need: dict = {}
    for r in stages["pack"].collect():
        got[r.doc_id] += r.length
        need[r.doc_id] = r.doc_tokens
    assert got == Counter({d: need[d] * n for d, n in docs.items()})


def test_odd_and_empty_tables_pass(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = P.run(spark, f"{tmp_path}/{name}")
        assert (got.count() > 0) == (name == "odd")
