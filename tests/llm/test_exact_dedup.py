"""Exact duplicates against a plain grouping of normalised texts."""

from collections import defaultdict

from brute import sha
from pyspark.sql import functions as F

from cellscope.llm import exact

DELETE = {ord(c): None for c in "\x20\x09\x0a\x0b\x0c\x0d"}


def plain(rows):
    """(id, keep_id, group_size, digest) of each row, and how many rows stay."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[sha((t or "").translate(DELETE))].append((-len(t or ""), i is None, i or 0, i))
    return sorted(str((i, min(g, key=lambda x: x[:3])[3], len(g), s)) for s, g in groups.items() for *_, i in g), len(groups)


def check(df):
    got = exact.mark_copies(df).collect()
    want, stay = plain([(r.doc_id, r.text) for r in df.collect()])
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert sum(r.kept for r in got) == stay
    assert len({r.text_sha256 for r in got if r.kept}) == stay
    return got


def test_odd_rows(odd, none):
    check(odd)
    check(odd.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    assert exact.mark_copies(none).count() == 0 and exact.drop_copies(none).count() == 0
    left = exact.drop_copies(odd)
    assert left.columns == odd.columns and left.schema["n_chars"] == odd.schema["n_chars"]
    assert left.count() == plain([(r.doc_id, r.text) for r in odd.collect()])[1]


def test_blanks_lengths_and_ties(spark):
    rows = [(9, "a b"), (4, "ab"), (3, "a  b"), (2, "\ta\x0bb\n"), (7, "a\x0c b "), (5, " \n"), (6, None), (1, ""), (8, "a b"), (None, "a \r\nb")]
    got = {r.doc_id: r for r in check(spark.createDataFrame(rows, "doc_id bigint, text string"))}
    assert {got[i].keep_id for i in (9, 4, 3, 2, 7)} == {2} and got[2].group_size == 6
    assert got[1].keep_id == 5 and got[6].keep_id == 5 and got[8].group_size == 1  # two blanks are longer than none


def test_hot_group_and_filter(spark, monkeypatch):
    """A third of the rows equal, several groups, and a filter so full that nearly all rows pass it."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same"))
                                  .when(F.col("id") % 3 == 1, F.concat(F.lit("pair "), (F.col("id") / 6).cast("int").cast("string")))
                                  .otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text")).repartition(7)
    check(df)
    monkeypatch.setattr(exact, "MAX_FILTER_BITS", exact.BLOCK_BITS)
    check(df)


def test_filter_misses_no_copy_and_passes_few_others(spark):
    rows = exact.digests(spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, F.floor(F.col("id") / 2))
                                                   .otherwise(F.col("id")).cast("string").alias("text")), "doc_id", "text")
    got = exact.possibly_repeated(rows, 20000)
    assert got.where("id < 200 and not repeated").count() == 0
    assert got.where("id >= 200 and repeated").count() < 20000 * 0.03


def test_only_repeated_rows_are_shuffled(spark):
    """The plan has no Python, and its rows without copies meet no exchange of texts."""
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    plan = exact.mark_copies(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
