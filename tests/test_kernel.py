"""Kernel features, the machine on them and fits at once, against plain numpy and one-by-one runs."""

import time

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cellscope.operators import hinge, kernel, train
from cellscope.operators.pools import at_once
from cellscope.sources import files

COLS = ["a", "b"]


def rings(spark, n=900, seed=3):
    """Two classes that no line parts: a disc and the ring around it; an id tells rows apart."""
    rng = np.random.default_rng(seed)
    r = np.where(np.arange(n) % 3 == 0, rng.uniform(1.6, 2.2, n), rng.uniform(0, 1, n))
    t = rng.uniform(0, 2 * np.pi, n)
    rows = [(i, float(r[i] * np.cos(t[i])), float(r[i] * np.sin(t[i])), int(i % 3 == 0), i % 5) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, y int, fold int").repartition(4)


def test_features_are_the_projection_on_the_landmarks(spark):
    df = rings(spark, 200)
    m = kernel.fit_kernel_map(df, COLS, "auto", landmarks=12, pilot=40, keys=["id"])
    rows = m.transform(df).select("a", "b", vector_to_array("features").alias("z"), m.missed().alias("missed")).collect()
    x, z = np.array([[r.a, r.b] for r in rows]), np.array([r.z for r in rows])
    points, _, gamma = m.matrices()
    assert gamma == 0.5 and len(points) == 12
    whole = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    near = np.exp(-gamma * ((x[:, None] - points[None]) ** 2).sum(-1))
    own = np.exp(-gamma * ((points[:, None] - points[None]) ** 2).sum(-1))
    assert np.allclose(z @ z.T, near @ np.linalg.pinv(own, rcond=1e-9, hermitian=True) @ near.T, atol=1e-6)
    e = kernel.kernel_error(df, m).first()
    assert abs(e.mean_missed - np.mean(1 - (z ** 2).sum(1))) < 1e-9 and e.n_rows == 200
    assert np.abs(whole - z @ z.T).max() <= e.max_missed + 1e-9
    more = kernel.kernel_error(df, kernel.fit_kernel_map(df, COLS, "auto", landmarks=60, keys=["id"])).first()
    assert more.max_missed < e.max_missed and more.mean_missed < min(e.mean_missed, 0.001)


def test_scores_and_gamma_rules(spark):
    rng = np.random.default_rng(5)
    pilot, rows = rng.normal(size=(30, 2)), rng.normal(size=(7, 2))
    k = lambda p, q: np.exp(-0.7 * ((p[:, None] - q[None]) ** 2).sum(-1))
    ridge = np.sort(np.linalg.eigvalsh(k(pilot, pilot)))[:-10].sum() / 10
    inverse = np.linalg.inv(k(pilot, pilot) + ridge * np.eye(30))
    want = [1 - v @ inverse @ v for v in k(rows, pilot)]
    assert np.allclose(kernel.leverage(pilot, 0.7, 10)(rows), want)
    df = rings(spark, 120)
    values = np.array([[r.a, r.b] for r in df.collect()])
    assert abs(kernel.gamma_of(df, COLS, "scale") - 1 / (2 * values.var())) < 1e-9
    assert kernel.gamma_of(df, COLS, "auto") == 0.5 and kernel.gamma_of(df, COLS, 3) == 3.0


def test_copies_do_not_fill_the_landmarks_and_reruns_agree(spark):
    df = rings(spark, 300)
    copies = spark.range(1000, 1150).select("id", F.lit(5.0).alias("a"), F.lit(5.0).alias("b"), F.lit(0).alias("y"), F.lit(0).alias("fold"))
    both = df.unionByName(copies)
    m = kernel.fit_kernel_map(both, COLS, "auto", landmarks=40, pilot=100, keys=["id"])
    again = kernel.fit_kernel_map(both.repartition(7), COLS, "auto", landmarks=40, pilot=100, keys=["id"])
    assert len(m.matrices()[0]) > 30 and np.array_equal(m.matrices()[0], again.matrices()[0])


def test_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, 0.0, 1.0)], "id int, a double, b double")
    m = kernel.fit_kernel_map(df, COLS, "scale", keys=["id"])
    z = [r.z for r in m.transform(df).select(vector_to_array("features").alias("z")).collect()]
    assert z[0] == z[1] == z[2] and len(m.matrices()[0]) == 1
    with pytest.raises(ValueError):
        kernel.fit_kernel_map(df.where("id > 9"), COLS, "auto", keys=["id"])


def test_machine_parts_rings_and_is_read_back(spark, tmp_path):
    df = rings(spark)
    m = train.fit_kernel_svm(df, COLS, "y", landmarks=40, keys=["id"])
    score = lambda model, s: {r.id: r.prob for r in train.svm_predict_proba(df if s is spark else s.table("rings"), model).collect()}
    got, truth = score(m, spark), {r.id: r.y for r in df.collect()}
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in got]) > 0.97
    assert set(train.svm_predict_proba(df, m).columns) == {*df.columns, "prob"}
    other = spark.newSession()
    df.write.parquet(f"{tmp_path}/rings")
    other.read.parquet(f"{tmp_path}/rings").createOrReplaceTempView("rings")
    assert score(files.load_model(files.save_model(m, f"{tmp_path}/svm")), other) == got


def test_search_finds_a_point_that_parts_rings(spark):
    grid = {"c": [0.01, 10.0], "gamma": ["scale", "auto"]}
    got = train.grid_search_svm(rings(spark, 400), COLS, "y", grid, landmarks=30, keys=["id"], k=5).collect()
    assert len(got) == 20 and {r.point for r in got} == {0, 1, 2, 3}
    best = [r for r in got if r.is_best]
    assert len(best) == 5 and best[0].mean_f1 == max(r.mean_f1 for r in got) > 0.95


def test_calls_at_once_keep_their_order(spark):
    begun = time.time()
    assert at_once(spark, [lambda i=i: (time.sleep(0.3), i)[1] for i in range(8)], 4) == list(range(8))
    assert time.time() - begun < 1.8

    def fail():
        raise KeyError("fold")
    with pytest.raises(KeyError):
        at_once(spark, [lambda: 1, fail, lambda: 2], 2)
    assert at_once(spark, []) == []


def test_fits_at_once_give_the_same_numbers(spark):
    df = rings(spark, 300)
    kw = dict(keys=["id"], k=5)
    plain = sorted(train.oof_predict(df, COLS, "y", threads=1, **kw).collect())
    assert sorted(train.oof_predict(df, COLS, "y", threads=5, **kw).collect()) == plain and len(plain) == 300
    x = df.withColumn("split_pos", F.col("id")).withColumn("split_rows", F.lit(300).cast("long"))
    grid = {"numTrees": [3], "maxDepth": [2, 3]}
    search = [sorted(train.grid_search_reg(x, COLS, "y", grid, threads=t).collect()) for t in (1, 4)]
    assert search[0] == search[1] and len(search[0]) == 10


def test_machines_equal_those_of_mllib(spark, monkeypatch):
    """Several blocks and tasks, two maps, machines of some parts of the rows and of all, weights."""
    from pyspark.ml.classification import LinearSVC
    monkeypatch.setattr(hinge, "BLOCK_ROWS", 100)
    monkeypatch.setattr(hinge, "CHUNK_ROWS", 32)
    df = rings(spark, 500).withColumn("w", 0.5 + F.rand(3)).withColumn("part", (F.floor(F.col("id") / 3) % 3).cast("int"))
    maps = [kernel.fit_kernel_map(df, COLS, g, landmarks=20, keys=["id"], out="kernel") for g in ("auto", 0.3)]
    machines = [hinge.Machine(0, 0.01, (0, 1, 2)), hinge.Machine(1, 0.001, (0, 2)), hinge.Machine(0, 0.1, (1, 2)), hinge.Machine(1, 0.0, (0, 2))]
    rows = hinge.packed(df, COLS, "y", F.col("part"), "w")
    got = hinge.fit_machines(rows, maps, machines, max_iter=12)
    tests = [0, 1, 0, 1]
    hits = hinge.sides(rows, maps, got, machines, tests)
    for (b, c), m, found, test in zip(got, machines, hits, tests, strict=True):
        x = maps[m.map].transform(df)
        want = LinearSVC(featuresCol="kernel", labelCol="y", weightCol="w", regParam=m.reg, maxIter=12).fit(x.where(F.col("part").isin(*m.train)))
        scale = np.abs(want.coefficients.toArray()).max()
        assert np.abs(want.coefficients.toArray() - b).max() < 1e-6 * scale and abs(want.intercept - c) < 1e-6 * scale
        side = want.transform(x.where(F.col("part") == test)).toPandas()
        said, true = side.prediction == 1, side.y == 1
        assert [(said & true).sum(), said.sum(), true.sum()] == found.tolist()
    with pytest.raises(ValueError):
        hinge.fit_machines(rows, maps, [hinge.Machine(0, 0.1, (7,))])


def test_machine_makes_no_kernel_features(spark, monkeypatch):
    """Fit, search and scores go without the wide features, and equal the stages of the fitted pipeline."""
    df = rings(spark, 300)

    def wide(*a):
        raise AssertionError("kernel features were made")
    monkeypatch.setattr(kernel.KernelMap, "_transform", wide)
    m = train.fit_kernel_svm(df, COLS, "y", landmarks=20, keys=["id"])
    train.grid_search_svm(df, COLS, "y", {"c": [1.0], "gamma": ["auto"]}, landmarks=20, keys=["id"], k=5).collect()
    got = {r.id: r.prob for r in train.svm_predict_proba(df, m).collect()}
    monkeypatch.undo()
    want = {r.id: r.prob for r in train.positive_prob(m.transform(df)).collect()}
    assert len(got) == 300 and all(abs(got[i] - p) < 1e-9 for i, p in want.items())
    with pytest.raises(Exception, match="label"):
        train.fit_kernel_svm(df.withColumn("y", F.when(F.col("id") > 5, F.col("y"))), COLS, "y", landmarks=20, keys=["id"])
