"""Rows stay spread over tasks, folds are numbered once, and wide features are not written."""

import numpy as np
from pyspark.sql import functions as F

from cellscope.operators import boosting, clean, ordering, splits, train


def tasks_with_rows(df):
    return df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(bool).count()


def test_class_weights_leave_rows_where_they_are(spark):
    df = spark.range(800).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("label")).repartition(8)
    got = splits.with_weight(df, "label", splits.class_weights(df, "label"))
    assert tasks_with_rows(got) == 8
    assert got.count() == 800 and got.where("weight is null").count() == 0  # NULL is a class as well


def test_fill_medians_leave_rows_where_they_are(spark):
    df = spark.range(800).select("id", (F.col("id") % 3).alias("g"), F.rand(1).alias("v")).repartition(8)
    med = ordering.exact_quantiles(df, ["v"], [0.5], by=["g"])
    got = ordering.join_null_safe(df, med, ["g"], "left")
    assert tasks_with_rows(got) == 8 and got.where("value is null").count() == 0


def counting(monkeypatch, module):
    """The columns of every frame that ``module`` checkpoints."""
    seen = []
    monkeypatch.setattr(module, "checkpointed", lambda df: seen.append(df.columns) or ordering.checkpointed(df))
    return seen


def test_fold_audit_splits_once(spark, monkeypatch):
    from cellscope.plans import split_queries as sq
    rows = spark.range(600).select((F.col("id") % 20).alias("battery_id"), F.col("id").alias("seq"), (F.col("id") % 20 % 2).cast("int").alias("over_temp_flag"))
    monkeypatch.setattr(sq, "telemetry", lambda *a: rows)
    seen = counting(monkeypatch, sq)
    got = {(r.kind, r.fold, r.role): (r.n_pos, r.n_neg) for r in sq.q_fold_audit(spark, "").collect()}
    assert seen == [["battery_id", "seq", "over_temp_flag", "split_pos", "split_rows"]]
    assert len(got) == 20 and got["stratified", 0, "test"] == (42, 42) and got["time", 0, "test"] == (30, 30)


def test_out_of_fold_check_numbers_rows_once(spark, monkeypatch):
    from cellscope.plans import check_queries as cq
    from cellscope.plans import model_queries as mq
    feats = [(F.rand(i) + F.col("id") % 2).alias(c) for i, c in enumerate(mq.CLS_FEATURES)]
    tr = spark.range(200).select((F.col("id") % 5).alias("battery_id"), F.col("id").alias("seq"), (F.col("id") % 2).cast("int").alias("over_temp_flag"),
                                 F.lit(1.0).alias("w_temp"), *feats)
    monkeypatch.setattr(mq, "parts", lambda *a: (tr, None, None))
    seen = counting(monkeypatch, cq)
    got = cq.q_oof_folds_check(spark, "")
    assert len(seen) == 1 and "fold" in seen[0]
    assert {(r["fold"], r["label"]): r["count"] for r in got.groupBy("fold", "label").count().collect()} == {(f, y): 20 for f in range(5) for y in (0, 1)}


def test_models_of_several_blocks_are_dealt_to_all_cores(spark, monkeypatch):
    """Few blocks and many models: each block meets a part of the models in a task of its own."""
    df = spark.range(700).select((F.col("id") % 37).cast("double").alias("a"), F.rand(5).alias("b"), (F.col("id") % 3).alias("part"),
                                 ((F.col("id") % 37 > 20).cast("double") + F.rand(6)).alias("y")).repartition(3)
    bounds = boosting.bin_bounds(df, ["a", "b"])
    specs = [boosting.Spec(rounds=r, depth=d, rate=0.4, train=(0, 1), test=(2,)) for r in (3, 30) for d in (1, 2, 4)]
    parts, kept = [], boosting.kept
    monkeypatch.setattr(boosting, "kept", lambda *a: parts.append(kept(*a)) or parts[-1])
    monkeypatch.setattr(boosting, "BLOCK_ROUNDS", 4)
    found = []
    for size in (240, 1000):
        monkeypatch.setattr(boosting, "BLOCK_ROWS", size)
        blocks = boosting.packed(df, ["a", "b"], "y", F.col("part"), bounds)
        found.append(boosting.fit_boosted(blocks, ["a", "b"], bounds, specs, patience=3))
        cores, tasks = spark.sparkContext.defaultParallelism, -(-700 // size)
        assert {p.getNumPartitions() for p in parts} == {min(len(specs), cores // tasks) * tasks} or cores < 2 * tasks
        parts.clear()
    for m, same in zip(*found, strict=True):
        assert len(m.trees) == len(same.trees) and m.best_round == same.best_round
        assert np.allclose(m.curve, same.curve)
    assert len({len(m.trees) for m in found[0]}) > 1


def test_a_search_over_one_block_is_few_jobs(spark):
    """Rows that fit one block: models are fitted whole in tasks, not by a job for each level."""
    df = spark.range(400).select((F.col("id") % 37).cast("double").alias("a"), F.rand(5).alias("y"), (F.col("id") % 3).alias("part")).repartition(2)
    bounds = boosting.bin_bounds(df, ["a"])
    blocks = boosting.packed(df, ["a"], "y", F.col("part"), bounds)
    specs = [boosting.Spec(rounds=40, depth=d, train=(0, 1), test=(2,)) for d in (1, 2, 3)]
    sc = spark.sparkContext
    sc.setJobGroup("whole", "whole fits")
    try:
        models = boosting.fit_boosted(blocks, ["a"], bounds, specs)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert [len(m.trees) for m in models] == [40] * 3 and len(sc.statusTracker().getJobIdsForGroup("whole")) < 12


def test_kernel_features_are_not_written(spark, monkeypatch):
    df = spark.range(0, 300, 1, 2).select("id", F.randn(1).alias("a"), F.randn(2).alias("b"), (F.col("id") % 5).cast("int").alias("fold")) \
        .withColumn("y", (F.col("a") * F.col("a") + F.col("b") * F.col("b") > 1).cast("int"))
    seen = counting(monkeypatch, train)
    train.fit_kernel_svm(df, ["a", "b"], "y", landmarks=10, keys=["id"])
    got = train.grid_search_svm(df, ["a", "b"], "y", {"c": [0.1, 1.0], "gamma": ["auto"]}, landmarks=10, keys=["id"], k=2).collect()
    assert len(got) == 4 and not any("kernel" in columns for columns in seen)
    assert train.kernel_fits(df, 10) > 1
    monkeypatch.setattr(train, "KERNEL_BYTES", 300 * 10 * 8)
    assert train.kernel_fits(df, 10) == 1


def test_a_written_frame_is_dealt_to_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "FILE_ROWS", 100)
    df = spark.range(800).select("id", F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("v")).coalesce(1)
    got = ordering.written(df)
    assert tasks_with_rows(got) > 1 and got.dtypes == df.dtypes
    assert got.exceptAll(df).count() == df.exceptAll(got).count() == 0


def test_fitted_values_are_literals(spark):
    """No row is attached to the frame; features without a value, without deviation or without a row."""
    df = spark.createDataFrame([(1.0, None, 5.0, None), (3.0, 4.0, 5.0, 2.0)], "a double, b double, c double, d double")
    med = spark.createDataFrame([("a", 9.0), ("b", 7.0), ("c", None)], "feature string, median double")
    stats = spark.createDataFrame([("a", 1.0, 2.0), ("b", 0.0, 0.0), ("c", 4.0, None)], "feature string, mean double, std double")
    imputed = clean.impute_apply(df, med, ["a", "b", "c", "d"])
    assert [tuple(r) for r in imputed.collect()] == [(1.0, 7.0, 5.0, None), (3.0, 4.0, 5.0, 2.0)]
    scaled = clean.scale_apply(imputed, stats, ["a", "b", "c", "d"])
    assert [tuple(r) for r in scaled.collect()] == [(0.0, 7.0, 1.0, None), (1.0, 4.0, 1.0, None)]
    assert "ubquery" not in scaled._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_filled_and_dealt_evenly(spark, monkeypatch):
    """Blocks are filled from many Arrow batches, their rows lie by part, and no task has two blocks more than another."""
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    df = spark.range(0, 4000, 1, 2).select(F.rand(1).alias("a"), F.rand(2).alias("y"), (F.col("id") % 3).alias("part"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        blocks = boosting.packed(df, ["a"], "y", F.col("part"), boosting.bin_bounds(df, ["a"]))
        got = blocks.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert [r["n"] for r in got] == [100] * 40
    parts = [np.frombuffer(r["part"], np.uint8) for r in got]
    assert all((np.diff(p) >= 0).all() for p in parts) and boosting.rows_of(parts[0], (0, 1)) == slice(0, int((parts[0] < 2).sum()))
    assert boosting.rows_of(np.array([0, 1, 2, 2]), (0, 2)).tolist() == [0, 2, 3]
    dealt = boosting.kept(blocks, 1, 7)
    sizes = dealt.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    dealt.unpersist()
    assert sum(sizes) == 40 and max(sizes) - min(sizes) <= 1


def test_workers_drop_the_block_met_longest_ago(monkeypatch):
    monkeypatch.setattr(boosting, "CACHE_BYTES", 3 * 80)
    monkeypatch.setattr(boosting, "_held", {})
    bins = np.zeros((1, 10), np.uint8)
    for key in (0, 1, 2, 0, 3):
        boosting._margins(key, bins, np.zeros((1, 10)), [[]])
    assert list(boosting._held) == [2, 0, 3]


def test_trees_read_assembled_rows_once(spark):
    """A forest gets the same rows from its frame and from vectors, and leaves nothing kept."""
    df = spark.range(0, 400, 1, 3).select(F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 2).cast("double").alias("y"))
    kept = len(spark.sparkContext._jsc.getPersistentRDDs())
    m = train.fit_rf(df, ["a", "b"], "y", numTrees=3, maxDepth=3)
    again = train.fit_rf(train.assemble(df, ["a", "b"]), ["a", "b"], "y", numTrees=3, maxDepth=3)
    assert m.stages[-1].toDebugString.split("\n")[1:] == again.stages[-1].toDebugString.split("\n")[1:]
    assert m.transform(df).count() == 400 and len(spark.sparkContext._jsc.getPersistentRDDs()) == kept


def test_split_drops_repeats_once(spark, monkeypatch):
    """A known bound on a battery's rows saves the count over rows without repeats."""
    df = spark.range(90).select((F.col("id") % 3).alias("battery_id"), F.col("id").alias("seq"))
    want = sorted(splits.chrono_split(df).collect())
    monkeypatch.setattr(ordering, "largest_group", lambda *a: 1 / 0)
    assert sorted(splits.chrono_split(df, largest=30).collect()) == want
