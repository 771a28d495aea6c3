"""Model training and selection with MLlib.

The prepared training frame is checkpointed once (reliable checkpoint in the shared
checkpoint dir) so the small driver loops below (grids, folds, RFE, learning curve) fit on
a short lineage; each fit itself is a distributed MLlib job."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cellscope.operators import boosting, hinge, kernel
from cellscope.operators import evaluate as ev
from cellscope.operators.ordering import checkpointed
from cellscope.operators.pools import FITS_AT_ONCE, at_once
from cellscope.operators.splits import ts_role

# Axes of the reference's command-line searches that have a counterpart in MLlib
# (its minimum split size becomes minInstancesPerNode, no depth limit becomes MLlib's largest).
RF_GRID = {"numTrees": [100, 200], "maxDepth": [5, 10, 30], "minInstancesPerNode": [2, 5],
           "featureSubsetStrategy": ["sqrt", "0.5"]}
GBT_REG_GRID = {"maxIter": [200, 500], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.05, 0.1]}
GBT_CLS_GRID = {"maxIter": [100, 300], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.05, 0.1]}
BOOSTED_GRID = {"rounds": [200, 500], "depth": [3, 5, 7], "rate": [0.01, 0.05, 0.1], "reg_alpha": [0.0, 1.0], "reg_lambda": [1.0, 10.0]}
SVM_GRID = {"c": [0.1, 1.0, 10.0], "gamma": ["scale", "auto"]}
LOGISTIC_C = 1.0
EARLY_STOP_ROUNDS = 50
RFE_TREES = 50
BYTE_DEPTH = 10
KERNEL_BYTES = 2 << 30  # of kernel features that fits at once hold


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def fit_linear(train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Ordinary least squares (normal equations, no regularization)."""
    lr = LinearRegression(featuresCol="features", labelCol=label, solver="normal", regParam=0.0)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), lr]).fit(train)


def fit_trees(train: DataFrame, features: Sequence[str], trees: Estimator, cols: Sequence[str]) -> PipelineModel:
    """Assemble and fit. Trees pass over their rows some four times before they hold bins of their own (numbers
    of rows and classes, splits, bins), so the vectors are kept for that long; in a frame that has them they are used."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="features")
    if "features" in train.columns:
        return PipelineModel(stages=[vectors, trees.fit(train)])
    x = vectors.transform(train).select("features", *cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return PipelineModel(stages=[vectors, trees.fit(x)])
    finally:
        x.unpersist()


def fit_rf(train: DataFrame, features: Sequence[str], label: str, seed: int = 42, **params) -> PipelineModel:
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed, **params)
    return fit_trees(train, features, rf, [label])


def fit_gbt_reg(train: DataFrame, features: Sequence[str], label: str, seed: int = 42, **params) -> PipelineModel:
    gbt = GBTRegressor(featuresCol="features", labelCol=label, seed=seed, **params)
    return fit_trees(train, features, gbt, [label])


def reg_of(c: float, train: DataFrame, weight_col: str | None = None) -> float:
    """MLlib's regParam for a penalty stated as C, which multiplies the summed loss: MLlib takes
    the mean loss, so it is 1 / (C n), with the sum of the weights for n if there are any."""
    n = train.agg(F.sum(weight_col)).first()[0] if weight_col else train.count()
    return 1.0 / (c * n) if n else 0.0


def fit_logistic(train: DataFrame, features: Sequence[str], label: str, weight_col: str | None = None,
                 c: float = LOGISTIC_C, **params) -> PipelineModel:
    """Class-weighted logistic regression with an L2 penalty on the given scale."""
    params = {"regParam": reg_of(c, train, weight_col), "elasticNetParam": 0.0, "standardization": False} | params
    lr = LogisticRegression(featuresCol="features", labelCol=label, **params)
    if weight_col:
        lr.setWeightCol(weight_col)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), lr]).fit(train)


def fit_gbt_cls(train: DataFrame, features: Sequence[str], label: str, weight_col: str | None = None,
                seed: int = 42, **params) -> PipelineModel:
    """MLlib's boosting. With rounds, depth and rate alone its trees are grown by ``boosting``, which holds rows as
    bytes and sums half of them a level, and equal those of MLlib; other parameters are left to MLlib."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, seed=seed, **params)
    if weight_col:
        gbt.setWeightCol(weight_col)
    vectors = VectorAssembler(inputCols=list(features), outputCol="features")
    if not byte_trees(params):
        return fit_trees(train, features, gbt, [label, *([weight_col] if weight_col else [])])
    rounds, depth, rate = gbt.getMaxIter(), gbt.getMaxDepth(), gbt.getStepSize()
    model = fit_gbt_points(train, features, label, [dict(rounds=rounds, depth=depth, rate=rate)], weight_col, seed)[0]
    steps = [1.0] + [rate] * (len(model.trees) - 1)
    return PipelineModel(stages=[vectors, gbt._copyValues(GBTClassificationModel(model.to_mllib(steps)))])


def byte_trees(params) -> bool:
    """Whether ``boosting`` grows these trees of MLlib: its nodes lie in heaps, so they may not be deep."""
    depths = params.get("maxDepth", 5)
    return {*params} <= {"maxIter", "maxDepth", "stepSize"} and max(depths if isinstance(depths, list) else [depths]) <= BYTE_DEPTH


def fit_gbt_points(data: DataFrame, features: Sequence[str], label: str, points: Sequence[dict], weight_col: str | None = None,
                   seed: int = 42, test: Column | None = None) -> list[boosting.Boosted]:
    """MLlib's boosted classifiers of several ``points`` (rounds, depth, rate) in the same passes, fitted on the rows
    that are not ``test``. A label that is missing or another than 0 and 1, or a feature that is missing, is an error."""
    y = F.col(label).cast("double")
    odd = y.isNull() | ~y.isin(0.0, 1.0)
    for c in features:
        odd = odd | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    data = data.withColumn("_y", F.when(odd, F.raise_error("label is not 0 or 1, or a feature is missing")).otherwise(y))
    own = data if test is None else data.where(~test)
    bounds, least = boosting.sampled_bounds(own, features, weight_col, seed)
    part = F.lit(0) if test is None else test.cast("int")
    blocks = boosting.packed(data, features, "_y", part, bounds, weight_col)
    # a child needs one row, that is half of the least weight at least
    return boosting.fit_boosted(blocks, features, bounds, [boosting.Spec(min_child=least / 2, reg_lambda=0.0, by_weight=True, **p) for p in points], True)


def kernel_fits(df: DataFrame, landmarks: int) -> int:
    """How many fits may run at once: what they hold together stays below ``KERNEL_BYTES``, or it is one."""
    return max(1, min(FITS_AT_ONCE, KERNEL_BYTES // max(1, df.count() * landmarks * 8)))


def fit_kernel_svm(train: DataFrame, features: Sequence[str], label: str, c: float = 1.0, gamma: str | float = "scale",
                   landmarks: int = kernel.LANDMARKS, weight_col: str | None = None, seed: int = 42, parts: int = 3,
                   keys: Sequence[str] = ("battery_id", "seq")) -> PipelineModel:
    """RBF SVM re-aimed for scale: kernel features of landmarks + LinearSVC, then a logistic
    calibration (probabilities) of margins that each part of the rows gets from a machine fitted on
    the other parts. One pipeline of map, machine, margin and calibration, saved like any other.

    Kernel features are many times as wide as their row. They are neither written nor kept: ``hinge`` fits
    all machines in the same passes over the rows' inputs and computes kernel values as it goes."""
    spark = train.sparkSession
    kmap = kernel.fit_kernel_map(train, features, gamma, landmarks, keys=keys, seed=seed, out="kernel")
    part = F.pmod(F.xxhash64(*features), F.lit(parts)).cast("int")
    svc = LinearSVC(featuresCol="kernel", labelCol=label, regParam=reg_of(c, train, weight_col), maxIter=50,
                    rawPredictionCol="margins", predictionCol="side")
    if weight_col:
        svc.setWeightCol(weight_col)
    margin = VectorSlicer(inputCol="margins", outputCol="margin", indices=[1])
    every = range(parts)
    machines = [hinge.Machine(0, svc.getRegParam(), tuple(p for p in every if p != i)) for i in (None, *every)]
    rows = hinge.packed(train, features, label, part, weight_col)
    try:
        (b, intercept), *others = hinge.fit_machines(rows, [kmap], machines, svc.getMaxIter(), svc.getTol())
    finally:
        rows.unpersist()
    at = part + 1  # element_at counts from 1
    held = F.element_at(kmap.dot(np.stack([o[0] for o in others], axis=1)), at) + F.element_at(F.array(*[F.lit(o[1]) for o in others]), at)
    # one number a row: written once, so that calibration does not map the rows again
    cal = LogisticRegression(featuresCol="margin", labelCol=label).fit(checkpointed(train.select(label, array_to_vector(F.array(held)).alias("margin"))))
    return PipelineModel(stages=[kmap, hinge.to_mllib(svc, spark, b, intercept), margin, cal])


def svm_predict_proba(df: DataFrame, model: PipelineModel, out: str = "prob") -> DataFrame:
    """The last stage's probability of class 1, without making the kernel features."""
    kmap, svm, _, cal = model.stages
    margin = kmap.dot(svm.coefficients.toArray()) + F.lit(svm.intercept)
    return df.withColumn(out, 1 / (1 + F.exp(-(F.lit(float(cal.coefficients[0])) * margin + F.lit(cal.intercept)))))


def grid_search_svm(data: DataFrame, features: Sequence[str], label: str, grid: dict, fold_col: str = "fold",
                    landmarks: int = kernel.LANDMARKS, weight_col: str | None = None, seed: int = 42, k: int = 5,
                    keys: Sequence[str] = ("battery_id", "seq")) -> DataFrame:
    """Every C and gamma rule on given folds, scored by the F1 of class 1. A fold's map is fitted on
    its training rows, once for all C. Returns (point, params, fold, mean_missed, f1), the mean of a
    point and whether it is best; a fold without class 1 in truth and prediction has F1 0."""
    spark = data.sparkSession

    def fold(rule, f):
        kmap = kernel.fit_kernel_map(data.where(F.col(fold_col) != f), features, rule, landmarks, keys=keys, seed=seed, out="kernel")
        return kmap, kernel.kernel_error(data.where(F.col(fold_col) == f), kmap).first()["mean_missed"]
    pairs = [(r, f) for r in grid["gamma"] for f in range(k)]
    maps = at_once(spark, [lambda r=r, f=f: fold(r, f) for r, f in pairs], kernel_fits(data, landmarks))
    weights = {r[0]: r[1] for r in data.groupBy(F.col(fold_col).cast("int")).agg(F.sum(weight_col or F.lit(1.0))).collect()}  # k rows
    total = [sum(v or 0.0 for g, v in weights.items() if g is not None and g != f) for f in range(k)]
    machines = [hinge.Machine(i, 1.0 / (c * total[f]) if total[f] else 0.0, tuple(p for p in range(k) if p != f))
                for i, (_, f) in enumerate(pairs) for c in grid["c"]]
    tests = [f for _, f in pairs for _ in grid["c"]]
    # as in fit_kernel_svm, kernel features are neither written nor kept, and all machines share passes
    rows = hinge.packed(data, features, label, F.col(fold_col), weight_col)
    try:
        fitted = hinge.fit_machines(rows, [m for m, _ in maps], machines)
        hits = hinge.sides(rows, [m for m, _ in maps], fitted, machines, tests)
    finally:
        rows.unpersist()
    scores = iter(2 * hit / (said + true) if said + true else 0.0 for hit, said, true in hits)
    found = [[(json.dumps({"c": c, "gamma": rule}), f, missed, next(scores)) for c in grid["c"]] for (rule, f), (_, missed) in zip(pairs, maps, strict=True)]
    names = {p: i for i, p in enumerate(json.dumps({"c": c, "gamma": r}) for r in grid["gamma"] for c in grid["c"])}
    rows = sorted((names[p], p, f, miss, float(v)) for got in found for p, f, miss, v in got)
    res = spark.createDataFrame(rows, "point int, params string, fold int, mean_missed double, f1 double")
    # res holds points x folds rows (driver-built): a window over it is bounded
    res = res.withColumn("mean_f1", F.avg("f1").over(Window.partitionBy("point")))
    best = F.min(F.struct((-F.col("mean_f1")).alias("m"), "point")).over(Window.partitionBy())
    return res.withColumn("is_best", F.col("point") == best["point"])


def positive_prob(pred: DataFrame, out: str = "prob") -> DataFrame:
    return pred.withColumn(out, vector_to_array("probability")[1])


def grid_points(grid: dict) -> list[dict]:
    pts = [{}]
    for k, vs in grid.items():
        pts = [dict(p, **{k: v}) for p in pts for v in vs]
    return pts


def grid_search_reg(data: DataFrame, features: Sequence[str], label: str, grid: dict, make=fit_rf, k: int = 5,
                    threads: int = FITS_AT_ONCE) -> DataFrame:
    """Every grid point x expanding time fold: fit on the fold's train rows, RMSE on its test
    rows; returns (point, params, fold, rmse), the point's ``mean_rmse`` and whether it is best.
    Fold roles are filters on the position columns of ``chrono_split``, so there is no join. Rows are
    assembled once for all fits and tests; ``make`` gets them with their ``features``."""
    spark = data.sparkSession
    rmse = RegressionEvaluator(labelCol=label, metricName="rmse")
    x = assemble(data, features).select("features", label, "split_pos", "split_rows").persist(StorageLevel.MEMORY_AND_DISK)

    def one(i, pt, f):
        m = make(x.where(ts_role(f, k) == "train"), features, label, **pt)
        return i, str(pt), f, float(rmse.evaluate(m.stages[-1].transform(x.where(ts_role(f, k) == "test"))))
    try:
        rows = at_once(spark, [lambda i=i, pt=pt, f=f: one(i, pt, f) for i, pt in enumerate(grid_points(grid)) for f in range(k)], threads)
    finally:
        x.unpersist()
    res = spark.createDataFrame(rows, "point int, params string, fold int, rmse double")
    # res holds points x folds rows (driver-built): a window over it is bounded
    res = res.withColumn("mean_rmse", F.avg("rmse").over(Window.partitionBy("point")))
    best = F.min(F.struct("mean_rmse", "point")).over(Window.partitionBy())
    return res.withColumn("is_best", F.col("point") == best["point"])


def grid_search_cls(data: DataFrame, features: Sequence[str], label: str, grid: dict, fold_col: str = "fold",
                    weight_col: str | None = None, seed: int = 42, k: int = 5) -> DataFrame:
    """Every point on user-supplied stratified folds, scored by the F1 of class 1, as ``CrossValidator`` does. A fold
    fits its points in the same passes, and the axis ``maxIter`` costs nothing: fewer rounds are a prefix of more.
    Axes other than rounds, depth and rate are left to ``CrossValidator``."""
    spark = data.sparkSession
    if byte_trees(grid):
        gbt, points = GBTClassifier(), grid_points(grid)
        full = [dict(rounds=p.get("maxIter", gbt.getMaxIter()), depth=p.get("maxDepth", gbt.getMaxDepth()), rate=p.get("stepSize", gbt.getStepSize()))
                for p in points]
        shapes = list(dict.fromkeys((p["depth"], p["rate"]) for p in full))
        specs = [dict(rounds=max(p["rounds"] for p in full if (p["depth"], p["rate"]) == s), depth=s[0], rate=s[1]) for s in shapes]

        def fold(f):
            models = fit_gbt_points(data, features, label, specs, weight_col, seed, F.col(fold_col).cast("int") == f)
            return [models[shapes.index((p["depth"], p["rate"]))].f1[p["rounds"]] for p in full]
        folds = at_once(spark, [lambda f=f: fold(f) for f in range(k)])
        rows = [(i, str(p), sum(f[i] for f in folds) / k) for i, p in enumerate(points)]
        return spark.createDataFrame(rows, "point int, params string, mean_f1 double")
    gbt = GBTClassifier(featuresCol="features", labelCol=label, seed=seed)
    if weight_col:
        gbt.setWeightCol(weight_col)
    pb = ParamGridBuilder()
    for name, vs in grid.items():
        pb = pb.addGrid(gbt.getParam(name), vs)
    maps = pb.build()
    ev_f1 = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
    cv = CrossValidator(estimator=gbt, estimatorParamMaps=maps, evaluator=ev_f1, foldCol=fold_col, numFolds=k, parallelism=2)
    # the validator caches the rows of each fold: nothing but what a fit reads
    x = assemble(data, features).select("features", label, F.col(fold_col).cast("int").alias(fold_col), *([weight_col] if weight_col else []))
    model = cv.fit(x)
    rows = [(i, str({p.name: v for p, v in m.items()}), float(a)) for i, (m, a) in enumerate(zip(maps, model.avgMetrics))]
    return spark.createDataFrame(rows, "point int, params string, mean_f1 double")


def oof_predict(data: DataFrame, features: Sequence[str], label: str, fold_col: str = "fold",
                keys: Sequence[str] = ("battery_id", "seq"), fit=fit_logistic, k: int = 5,
                threads: int = FITS_AT_ONCE, **params) -> DataFrame:
    """Out-of-fold probabilities: for each of the k folds, fit on the others and score this one."""
    models = at_once(data.sparkSession, [lambda f=f: fit(data.where(F.col(fold_col) != f), features, label, **params) for f in range(k)], threads)
    parts = [positive_prob(m.transform(data.where(F.col(fold_col) == f))).select(*keys, fold_col, label, "prob") for f, m in enumerate(models)]
    return reduce(DataFrame.unionByName, parts)


def fit_boosted_val(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, rounds: int = 200,
                    patience: int | None = EARLY_STOP_ROUNDS, weight_col: str | None = None, logistic: bool = False,
                    **params) -> boosting.Boosted:
    """Boosting with L1 and L2 penalties (``depth``, ``rate``, ``reg_alpha``, ``reg_lambda``) on
    ``train``, stopped by the loss on ``val``."""
    bounds = boosting.bin_bounds(train, features)
    cols = [*features, label, *([weight_col] if weight_col else [])]
    both = train.select(*cols, F.lit(0).alias("_part")).unionByName(val.select(*cols, F.lit(1).alias("_part")))
    blocks = boosting.packed(both, features, label, F.col("_part"), bounds, weight_col)
    return boosting.fit_boosted(blocks, features, bounds, [boosting.Spec(rounds=rounds, **params)], logistic, patience)[0]


def early_stop_curve(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, max_iter: int = 200,
                     patience: int = EARLY_STOP_ROUNDS, maxDepth: int = 6, stepSize: float = 0.1, **params) -> DataFrame:
    """Per-round train / val RMSE of a boosted regressor that stops after ``patience`` rounds
    without a better one: no round after ``stopped_at`` is fitted."""
    m = fit_boosted_val(train, val, features, label, max_iter, patience, depth=maxDepth, rate=stepSize, **params)
    rows = [(i, a, b, m.best_round, len(m.trees)) for i, (a, b) in enumerate(m.curve[1:], 1)]
    return train.sparkSession.createDataFrame(rows, "round int, train_rmse double, val_rmse double, best_round int, stopped_at int")


def time_part(k: int = 5, pos_col: str = "split_pos", count_col: str = "split_rows") -> Column:
    """0 for rows that every time fold trains on, f + 1 for the test part of fold f."""
    p, n = F.col(pos_col), F.col(count_col)
    s = F.floor(n / (k + 1))
    return F.when(p < n - k * s, 0).otherwise(F.floor((p - (n - k * s)) / F.greatest(s, F.lit(1))) + 1).cast("int")


def grid_search_boosted(data: DataFrame, features: Sequence[str], label: str, grid: dict, k: int = 5,
                        patience: int | None = None) -> DataFrame:
    """Every point of ``grid`` on expanding time folds, in the same passes over the data. The axis
    ``rounds`` costs nothing: a point's model is the prefix of the one with the most rounds. With
    ``patience`` a fold's model stops early, and a point takes its best prefix of at most ``rounds``.
    Returns (point, params as JSON, fold, trees, rmse), the point's mean and whether it is best."""
    spark = data.sparkSession
    axes = {a: v for a, v in grid.items() if a != "rounds"}
    rounds = sorted(grid["rounds"])
    bounds = boosting.bin_bounds(data, features)
    blocks = boosting.packed(data, features, label, time_part(k), bounds)
    base = grid_points(axes)
    specs = [boosting.Spec(rounds=rounds[-1], train=tuple(range(f + 1)), test=(f + 1,), **p) for p in base for f in range(k)]
    models = boosting.fit_boosted(blocks, features, bounds, specs, patience=patience)
    rows = []
    for i, p in enumerate(base):
        for r in rounds:
            for f in range(k):
                curve = [v for _, v in models[i * k + f].curve[:r + 1]]
                at = len(curve) - 1 if patience is None else min(range(1, len(curve)), key=lambda j: (curve[j], j), default=0)
                rows.append((len(rows) // k, json.dumps(p | {"rounds": r}), f, at, float(curve[at])))
    res = spark.createDataFrame(rows, "point int, params string, fold int, trees int, rmse double")
    # res holds points x folds rows (driver-built): a window over it is bounded
    res = res.withColumn("mean_rmse", F.avg("rmse").over(Window.partitionBy("point")))
    best = F.min(F.struct("mean_rmse", "point")).over(Window.partitionBy())
    return res.withColumn("is_best", F.col("point") == best["point"])


def refit_best(found: DataFrame, train: DataFrame, val: DataFrame, features: Sequence[str], label: str,
               patience: int | None = EARLY_STOP_ROUNDS) -> boosting.Boosted:
    """The best point of ``grid_search_boosted`` fitted on all training rows, stopped by ``val``;
    the model is its best prefix."""
    params = json.loads(found.where("is_best").first()["params"])
    m = fit_boosted_val(train, val, features, label, patience=patience, **params)
    return m.prefix(m.best_round) if patience is not None else m


def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Importances of the last (tree) stage, ranked."""
    spark = SparkSession.getActiveSession()
    imp = model.stages[-1].featureImportances.toArray()
    rows = sorted(((f, float(v)) for f, v in zip(features, imp)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


def rfe(train: DataFrame, features: Sequence[str], label: str, keep: int = 15, step: int = 1,
        seed: int = 42) -> DataFrame:
    """Recursive elimination: fit RF(50), drop the weakest ``step`` features, repeat until
    ``keep`` remain. Returns (feature, rank): selected features rank 1, then elimination order."""
    spark = train.sparkSession
    current = list(features)
    ranks: dict[str, int] = {}
    while len(current) > keep:
        m = fit_rf(train, current, label, seed=seed, numTrees=RFE_TREES)
        imp = m.stages[-1].featureImportances.toArray()
        order = sorted(range(len(current)), key=lambda i: (imp[i], current[i]))
        drop = [current[i] for i in order[:min(step, len(current) - keep)]]
        for d in drop:
            ranks[d] = len(current) - keep + 1
        current = [c for c in current if c not in drop]
    rows = [(c, 1) for c in current] + sorted(ranks.items(), key=lambda kv: kv[1])
    return spark.createDataFrame(rows, "feature string, rank int")


def curve_prefix(fraction: float, k: int = 5, pos_col: str = "split_pos", count_col: str = "split_rows") -> Column:
    """The rows of a learning-curve prefix: in each sequence the first part of the first time
    fold's train rows, by which the fractions are measured."""
    n = F.col(count_col)
    return F.col(pos_col) < F.floor((n - k * F.floor(n / (k + 1))) * F.lit(float(fraction)))


def learning_curve(data: DataFrame, features: Sequence[str], label: str,
                   fractions: Sequence[float] = tuple(i / 10 for i in range(1, 11)), make=fit_linear, k: int = 5) -> DataFrame:
    """Train and validation RMSE for growing train prefixes, mean and std over k time folds. All
    folds share a prefix, since it lies in the first one's train part, so each fraction is
    fitted once and its errors on all test parts come from one pass."""
    spark = data.sparkSession
    error = F.sqrt(F.avg((F.col("prediction") - F.col(label)) * (F.col("prediction") - F.col(label))))

    def one(fr):
        tr = data.where(curve_prefix(fr, k))
        m = make(tr, features, label)
        own = m.transform(tr).agg(error.alias("e"), F.count(F.lit(1)).alias("n")).first()
        tested = F.array_compact(F.array(*[F.when(ts_role(f, k) == "test", F.lit(f)) for f in range(k)]))
        each = m.transform(data).withColumn("fold", F.explode(tested)).groupBy("fold").agg(error.alias("e")).collect()  # k rows
        return [(float(fr), int(r["fold"]), int(own["n"]), own["e"], r["e"]) for r in each]
    rows = [r for got in at_once(spark, [lambda fr=fr: one(fr) for fr in fractions]) for r in got]
    res = spark.createDataFrame(rows, "fraction double, fold int, train_rows long, train_rmse double, val_rmse double")
    agg = res.groupBy("fraction").agg(F.max("train_rows").alias("train_rows"), F.avg("train_rmse").alias("train_rmse"),
                                      F.avg("val_rmse").alias("val_rmse"), F.stddev("val_rmse").alias("val_std"))
    return agg.withColumn("diagnosis", ev.learning_gap_band(F.col("train_rmse"), F.col("val_rmse")))
