"""RBF kernel features for linear machines: the Nystrom map of landmarks drawn by leverage.

A row's ridge leverage score says how badly the others span it in the kernel's space. It is
estimated against a uniform pilot of rows in one pass; landmarks are a sample of fixed size with
chances by these scores, drawn by exponential keys, so every task passes on ``landmarks`` rows at
most. A row's features are its kernel values with the landmarks, whitened by the landmarks' own
kernel matrix: inner products of features are then the kernel's projection on the landmarks.

What the projection misses of a row, 1 - |z|^2, is exact and needs no pairs: the missed parts are
inner products themselves, so no entry of the kernel matrix is off by more than the largest of
them. ``kernel_error`` gives their mean and largest over all rows.

Pilot and landmarks are bounded by their parameters, whatever the rows. NULL and NaN inputs count
as 0, the mean of a scaled feature. Copies of a row share its score, so a row that makes up a third
of all rows does not fill the landmarks. A table without rows has no map (ValueError).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANDMARKS = 256
TINY = 1e-9   # eigenvalues below this share of the largest are noise


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(d, 0.0))


def number(name: str) -> Column:
    return F.nanvl(F.coalesce(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))


def inputs(features: Sequence[str]) -> Column:
    return F.array(*[number(c) for c in features])


def by_batch(of, returns: str):
    """A pandas UDF from arrays of inputs; ``of`` maps a matrix of rows to one result a row."""
    import pandas as pd

    def run(x):
        return pd.Series(list(of(np.stack(x.to_numpy()))) if len(x) else [], dtype=object if returns.startswith("array") else float)
    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, returns)


class KernelMap(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted map: ``points`` (landmarks x inputs) and ``whitening`` (landmarks x rank), row by row."""

    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)
    points = Param(Params._dummy(), "points", "landmarks, row by row", TypeConverters.toListFloat)
    whitening = Param(Params._dummy(), "whitening", "inverse root of their kernel matrix, row by row", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, gamma=None, points=None, whitening=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def matrices(self) -> tuple[np.ndarray, np.ndarray, float]:
        p = np.array(self.getOrDefault(self.points)).reshape(-1, len(self.getInputCols()))
        return p, np.array(self.getOrDefault(self.whitening)).reshape(len(p), -1), self.getOrDefault(self.gamma)

    def _transform(self, df: DataFrame) -> DataFrame:
        points, whitening, gamma = self.matrices()
        project = by_batch(lambda m: rbf(m, points, gamma) @ whitening, "array<double>")
        return df.withColumn(self.getOutputCol(), array_to_vector(project(inputs(self.getInputCols()))))

    def dot(self, coefficients: np.ndarray) -> Column:
        """A row's features times ``coefficients``, or with several columns of them an array: the features are not made."""
        points, whitening, gamma = self.matrices()
        near, many = whitening @ coefficients, np.ndim(coefficients) > 1
        return by_batch(lambda m: rbf(m, points, gamma) @ near, "array<double>" if many else "double")(inputs(self.getInputCols()))

    def missed(self) -> Column:
        """What the map misses of a row: 1 - |z|^2, in [0, 1]."""
        points, whitening, gamma = self.matrices()
        return by_batch(lambda m: np.clip(1 - ((rbf(m, points, gamma) @ whitening) ** 2).sum(1), 0.0, 1.0), "double")(inputs(self.getInputCols()))


def gamma_of(df: DataFrame, features: Sequence[str], rule: str | float) -> float:
    """``auto``: one by the number of features; ``scale``: that by the variance of all their values."""
    if not isinstance(rule, str):
        return float(rule)
    if rule == "auto":
        return 1.0 / len(features)
    if rule != "scale":
        raise ValueError(rule)
    v = df.select(F.explode(inputs(features)).alias("v")).agg(F.var_pop("v")).first()[0]
    return 1.0 / (len(features) * v) if v else 1.0


def leverage(pilot: np.ndarray, gamma: float, landmarks: int):
    """Function from a matrix of rows to their ridge leverage scores against the pilot, up to one
    factor. The ridge is the share of the pilot's spectrum that ``landmarks`` directions leave."""
    k = rbf(pilot, pilot, gamma)
    values = np.sort(np.linalg.eigvalsh(k))[::-1]
    ridge = max(values[landmarks:].sum() / landmarks, TINY * values[0])
    inverse = np.linalg.inv(k + ridge * np.eye(len(k)))

    def scores(m):
        near = rbf(m, pilot, gamma)
        return np.maximum(1 - ((near @ inverse) * near).sum(1), TINY)
    return scores


def fit_kernel_map(df: DataFrame, features: Sequence[str], gamma: str | float = "scale", landmarks: int = LANDMARKS,
                   pilot: int | None = None, keys: Sequence[str] = ("battery_id", "seq"), seed: int = 42, out: str = "features") -> KernelMap:
    """``keys`` tell rows apart: the draw hangs on them, so reruns choose the same landmarks. The
    pilot has twice as many rows as landmarks are drawn."""
    pilot = 2 * landmarks if pilot is None else pilot
    width = gamma_of(df, features, gamma)
    unit = lambda n: (F.pmod(F.xxhash64(*keys, F.lit(seed + n)), F.lit(2**52)) + 0.5) / 2.0**52
    x = df.select(inputs(features).alias("x"), unit(0).alias("u"), unit(1).alias("v"))
    rows = [r["x"] for r in x.orderBy("u", "x").limit(pilot).select("x").collect()]   # at most ``pilot`` rows
    if not rows:
        raise ValueError("no rows to choose landmarks from")
    score = by_batch(leverage(np.array(rows), width, landmarks), "double")
    keyed = x.select("x", (-F.log("v") / score("x")).alias("key"))
    points = np.unique(np.array([r["x"] for r in keyed.orderBy("key", "x").limit(landmarks).collect()]), axis=0)
    values, vectors = np.linalg.eigh(rbf(points, points, width))
    kept = values > TINY * values[-1]
    return KernelMap(inputCols=list(features), outputCol=out, gamma=width, points=points.ravel().tolist(),
                     whitening=(vectors[:, kept] / np.sqrt(values[kept])).ravel().tolist())


def kernel_error(df: DataFrame, kernel_map: KernelMap) -> DataFrame:
    """One row: gamma, landmarks, rank, n_rows, and the mean and largest part that the map misses of
    a row of ``df``; the largest bounds the error of every entry of the kernel matrix."""
    points, whitening, gamma = kernel_map.matrices()
    return df.select(kernel_map.missed().alias("m")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("m").alias("mean_missed"), F.max("m").alias("max_missed")) \
        .select(F.lit(gamma).alias("gamma"), F.lit(len(points)).alias("landmarks"), F.lit(whitening.shape[1]).alias("rank"), "*")
