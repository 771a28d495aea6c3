"""Histogram boosting against a plain numpy version, prefixes and stopping."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellscope.operators import boosting as B
from cellscope.operators import train
from tests.conftest import SF_SMALL


def plain_tree(bins, g, h, s):
    """{node in heap order: (feature, bound) or value}, every split tried by itself."""
    out = {}

    def cut(v):
        return math.copysign(max(abs(v) - s.reg_alpha, 0), v)

    def score(a, b):
        return cut(a) ** 2 / (b + s.reg_lambda)

    def grow(node, rows, level):
        best = (1e-12, None)
        if level < s.depth:
            for f in range(len(bins)):
                for b in range(B.BINS):
                    left = rows[bins[f, rows] <= b]
                    right = rows[bins[f, rows] > b]
                    if h[left].sum() < s.min_child or h[right].sum() < s.min_child:
                        continue
                    gain = 0.5 * (score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[rows].sum(), h[rows].sum()))
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, b, left, right))
        if best[1] is None:
            out[node] = -cut(g[rows].sum()) / (h[rows].sum() + s.reg_lambda) * s.rate
        else:
            f, b, left, right = best[1]
            out[node] = (f, b)
            grow(2 * node + 1, left, level + 1)
            grow(2 * node + 2, right, level + 1)
    grow(0, np.arange(bins.shape[1]), 0)
    return out


def fixture(spark, n=700, seed=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) * x[:, 1] + 0.5 * np.abs(x[:, 2]) + rng.normal(size=n) * 0.1
    rows = [(*map(float, r), float(v), int(v > 0.4), i % 3, float(1 + i % 2)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, flag int, part int, w double").repartition(3)
    return df, list("abcd")


@pytest.mark.parametrize("logistic", [False, True])
def test_trees_equal_a_plain_version(spark, monkeypatch, logistic):
    monkeypatch.setattr(B, "BLOCK_ROUNDS", 2)
    df, names = fixture(spark)
    label = "flag" if logistic else "y"
    bounds = B.bin_bounds(df, names)
    blocks = B.packed(df, names, label, F.col("part"), bounds, "w")
    specs = [B.Spec(rounds=5, depth=3, rate=0.3, train=(0, 1), test=(2,)), B.Spec(rounds=3, depth=2, reg_alpha=4.0, reg_lambda=10.0, train=(1, 2), test=(0,)),
             B.Spec(rounds=4, depth=4, min_child=30.0, train=(0,), test=(1,))]
    models = B.fit_boosted(blocks, names, bounds, specs, logistic)
    rows = df.collect()
    bins = B.binned([np.array([r[c] for r in rows]) for c in names], [np.array(b) for b in bounds])
    y, w, part = (np.array([r[c] for r in rows], float) for c in (label, "w", "part"))
    for s, m in zip(specs, models, strict=True):
        trains, tests = np.isin(part, s.train), np.isin(part, s.test)
        margin = np.full(len(rows), m.base)
        assert len(m.trees) == s.rounds and len(m.curve) == s.rounds + 1
        for i, t in enumerate(m.trees):
            g, h, loss = B.gradients(margin, y, w, logistic)
            mean = loss[tests].sum() / w[tests].sum()
            assert abs(m.curve[i][1] - (mean if logistic else math.sqrt(mean))) < 1e-9
            want = plain_tree(bins[:, trains], g[trains], h[trains], s)
            for node, v in want.items():
                if isinstance(v, tuple):
                    assert (t.feature[node], t.bound[node]) == v, (i, node)
                else:
                    assert t.feature[node] == -1 and abs(t.value[node] - v) < 1e-9, (i, node)
            margin += t.value[B.leaf_of(t, bins)]
        assert m.curve[-1][0] < m.curve[0][0]


def test_search_equals_separate_fits(spark):
    df, names = fixture(spark)
    data = df.withColumn("split_pos", F.monotonically_increasing_id()).withColumn("split_rows", F.lit(700))
    data = data.withColumn("split_pos", F.row_number().over(__import__("pyspark").sql.Window.orderBy("split_pos")) - 1)
    grid = {"rounds": [2, 6], "depth": [2, 3], "rate": [0.3], "reg_alpha": [0.0, 1.0]}
    found = train.grid_search_boosted(data, names, "y", grid, k=3).collect()
    assert len(found) == 8 * 3 and len({r.point for r in found if r.is_best}) == 1
    one = [r for r in found if '"rounds": 2' in r.params and '"depth": 3' in r.params and '"reg_alpha": 1.0' in r.params and r.fold == 1][0]
    n, s = 700, 700 // 4
    roles = [(n - (3 - f) * s, n - (2 - f) * s) for f in range(3)]
    a, b = roles[1]
    part = F.when(F.col("split_pos") < a, 0).when(F.col("split_pos") < b, 1).otherwise(2)
    bounds = B.bin_bounds(data, names)
    alone = B.fit_boosted(B.packed(data, names, "y", part, bounds), names, bounds, [B.Spec(rounds=2, depth=3, rate=0.3, reg_alpha=1.0)])[0]
    assert abs(alone.curve[2][1] - one.rmse) < 1e-9 and one.trees == 2
    model = train.refit_best(train.grid_search_boosted(data, names, "y", grid, k=3), data.where("part < 2"), data.where("part = 2"), names, "y", patience=2)
    assert 1 <= len(model.trees) <= 6


def weighted(spark, n=900):
    df, names = fixture(spark, n)
    return df.withColumn("w", F.when(F.col("flag") == 1, 2.5).otherwise(0.7)).withColumn("c", F.round("c")), names


@pytest.mark.parametrize("size", [100, 5000])
def test_classifier_equals_that_of_mllib(spark, monkeypatch, size):
    """The same trees by one task and by several, a weighted label, saved and read again."""
    from pyspark.ml.classification import GBTClassifier
    monkeypatch.setattr(B, "BLOCK_ROWS", size)
    df, names = weighted(spark)
    m = train.fit_gbt_cls(df, names, "flag", weight_col="w", maxIter=12, maxDepth=4, stepSize=0.2)
    gbt = GBTClassifier(labelCol="flag", weightCol="w", seed=42, maxIter=12, maxDepth=4, stepSize=0.2)
    want = train.fit_trees(df, names, gbt, ["flag", "w"])
    assert type(m.stages[-1]) is type(want.stages[-1]) and m.stages[-1].treeWeights == want.stages[-1].treeWeights
    score = lambda x: np.array([r[0] for r in train.positive_prob(x.transform(df.coalesce(1))).orderBy("a", "b", "c", "d").select("prob").collect()])
    assert np.abs(score(m) - score(want)).max() < 1e-9
    share = lambda x: x.stages[-1].featureImportances.toArray()
    assert np.allclose(share(m)[1:3], share(want)[1:3]) and np.allclose(share(m).sum(), 1)  # one split by a is as good as by d
    assert [r.prediction for r in m.transform(df).collect()] == [r.prediction for r in want.transform(df).collect()]


def test_thresholds_equal_those_of_mllib(spark):
    """Few values, many values, one value, zeros; more bins than rows."""
    from pyspark.ml.regression import DecisionTreeRegressor
    df, names = weighted(spark, 400)
    df = df.withColumn("d", F.lit(3.0)).withColumn("b", F.when(F.col("b") > 0, F.col("b")).otherwise(0.0))
    got, least = B.sampled_bounds(df, names, "w")
    assert least == 0.7 and got[3] == [] and len(got[0]) <= 31 and got[2] == sorted(got[2])
    for i, c in enumerate(names[:3]):
        tree = DecisionTreeRegressor(labelCol="y", weightCol="w", maxDepth=9, featuresCol="features")
        text = train.fit_trees(df, [c], tree, ["y", "w"]).stages[-1].toDebugString
        used = {float(line.split("<= ")[1].split(")")[0]) for line in text.split("\n") if "<= " in line}
        assert used <= set(got[i]) and len(used) > 1
    assert B.sampled_bounds(df.where("a > 1e9"), names, "w") == ([[]] * 4, 0.0)


def test_classifier_search_equals_the_validator(spark, monkeypatch):
    df, names = weighted(spark, 500)
    grid = {"maxIter": [2, 5], "maxDepth": [2, 3], "stepSize": [0.1, 0.5]}
    got = train.grid_search_cls(df, names, "flag", grid, "part", "w", k=3).collect()
    monkeypatch.setattr(train, "byte_trees", lambda p: False)
    want = train.grid_search_cls(df, names, "flag", grid, "part", "w", k=3).collect()
    assert [r.params for r in got] == [r.params for r in want] and len(got) == 8
    assert np.allclose([r.mean_f1 for r in got], [r.mean_f1 for r in want])


def test_missing_labels_and_features_are_errors(spark):
    df, names = weighted(spark, 60)
    for c in ("flag", "b"):
        with pytest.raises(Exception, match="missing"):
            train.fit_gbt_cls(df.withColumn(c, F.when(F.col("a") < 1, F.col(c))), names, "flag", maxIter=1)


def test_stops_and_fits_no_round_more(spark):
    df, names = fixture(spark, 300)
    noise = df.withColumn("y", F.rand(3))
    m = train.fit_boosted_val(noise.where("part < 2"), noise.where("part = 2"), names, "y", rounds=200, patience=4, depth=4, rate=0.5)
    assert len(m.trees) == m.best_round + 4 < 200
    assert m.curve[m.best_round][1] == min(v for _, v in m.curve[1:])


def test_predictions_saving_and_edges(spark, tmp_path):
    df, names = fixture(spark)
    m = train.fit_boosted_val(df.where("part < 2"), df.where("part = 2"), names, "y", rounds=8, patience=None, depth=3, rate=0.3)
    error = F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))
    assert abs(m.transform(df.where("part = 2")).agg(error).first()[0] - m.curve[-1][1]) < 1e-9
    assert abs(m.prefix(3).transform(df.where("part = 2")).agg(error).first()[0] - m.curve[3][1]) < 1e-9
    m.save(spark, f"{tmp_path}/m")
    back = B.Boosted.load(spark, f"{tmp_path}/m")
    assert back.transform(df).agg(F.sum("prediction")).first() == m.transform(df).agg(F.sum("prediction")).first()
    holes = df.withColumn("a", F.when(F.col("part") == 0, F.col("a"))).withColumn("b", F.lit(None).cast("double")).withColumn("d", F.lit(1.0))
    got = train.fit_boosted_val(holes, holes, names, "y", rounds=2, patience=None, depth=2)
    assert got.transform(holes).where("prediction is null or isnan(prediction)").count() == 0
    assert {f for t in got.trees for f in t.feature.tolist()} <= {-1, 0, 2}
    none = train.fit_boosted_val(df.where("part = 9"), df.where("part = 9"), names, "y", rounds=2)
    assert none.transform(df).count() == 700


def test_sums_of_many_tasks(spark, monkeypatch):
    df, names = fixture(spark)
    bounds = B.bin_bounds(df, names)
    monkeypatch.setattr(B, "BLOCK_ROWS", 50)
    blocks = B.packed(df, names, "y", F.col("part"), bounds)
    spec = [B.Spec(rounds=3, depth=3)]
    got = B.fit_boosted(blocks, names, bounds, spec * 3)
    monkeypatch.setattr(B, "BLOCK_ROWS", 1000)
    want = B.fit_boosted(blocks, names, bounds, spec)[0]
    assert all(np.allclose(want.curve, g.curve) for g in got)


def test_curve_of_the_small_table(spark):
    from cellscope.plans import model_queries as mq
    tr, va, _ = mq.parts(spark, SF_SMALL)
    c = train.early_stop_curve(tr, va, mq.REG_FEATURES, mq.Y, max_iter=60, patience=5, maxDepth=3).collect()
    assert [r["round"] for r in c] == list(range(1, c[0].stopped_at + 1)) and c[0].stopped_at <= c[0].best_round + 5
