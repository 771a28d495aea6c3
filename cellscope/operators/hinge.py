"""Linear machines over kernel features (MLlib's ``LinearSVC``), many fitted in the same passes.

A machine's margin is linear in the whitened kernel features z = W'k of a row, so it is k'(W b): a pass
over the rows needs their kernel values k with the landmarks only, and no whitened feature is made or kept.
What is kept is the rows' inputs, packed into blocks. All machines that ask for a loss and gradient at
some point get them from one job, in which a map's kernel values are computed once for all of its machines.
Tasks return a few hundred numbers a machine.

Loss, scaling, centering and optimizer are those of ``LinearSVC``: hinge loss of features with unit
deviation, an L2 penalty on their coefficients, and Breeze's OWL-QN without an L1 penalty, step by step.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscope.operators import kernel
from cellscope.operators.boosting import rows_of

BLOCK_ROWS = 1 << 14
CHUNK_ROWS = 1 << 10     # rows whose kernel values are held at a time
TASK_ROWS = 1 << 13      # a task at least, and of more rows
TASKS = 4                # a core at most
TRIES = 20               # step lengths of a line search


@dataclass(frozen=True)
class Machine:
    """One machine to fit: its map's place, its penalty, and the parts of the rows that train it."""
    map: int
    reg: float
    train: tuple[int, ...]


def packed(df: DataFrame, features: Sequence[str], label: str, part: Column, weight: str | None = None) -> RDD:
    """Blocks (x with its square and 1, y, w, part) of rows that lie by part, kept by the executors and dealt
    evenly. A label other than 0 and 1 or a weight that is missing or below 0 is an error, as in MLlib."""
    y, w = F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.when(y.isin(0.0, 1.0), y).otherwise(F.raise_error(F.lit("label is not 0 or 1")))
    w = F.when(w >= 0, w).otherwise(F.raise_error(F.lit("a weight is missing or below 0")))
    x = df.select(*[kernel.number(c).alias(f"f{i}") for i, c in enumerate(features)], y.alias("y"), w.alias("w"), part.cast("int").alias("part"))
    names = ["x", "y", "w", "part"]

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        *c, y, w, part = [v.to_numpy() for v in pa.Table.from_batches(held).columns]
        by = np.argsort(part, kind="stable")
        rows = np.stack(c, axis=1)[by]
        rows = np.concatenate([rows, (rows * rows).sum(1)[:, None], np.ones((len(rows), 1))], axis=1)
        return pa.RecordBatch.from_arrays([pa.array([d.tobytes()], pa.binary()) for d in (rows, y[by], w[by], part[by].astype(np.uint8))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, BLOCK_ROWS - n))
                n += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if n == BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)
    rows = x.mapInArrow(run, "x binary, y binary, w binary, part binary").rdd.map(lambda r: tuple(bytes(v) for v in r)).persist(StorageLevel.MEMORY_AND_DISK)
    most = max(rows.getNumPartitions(), TASKS * df.sparkSession.sparkContext.defaultParallelism)
    tasks = max(1, min(most, math.ceil(rows.map(lambda r: len(r[3])).sum() / TASK_ROWS)))
    dealt = rows.zipWithIndex().map(lambda t: (t[1] % tasks, t[0])).partitionBy(tasks, int).values().persist(StorageLevel.MEMORY_AND_DISK)
    dealt.count()
    rows.unpersist()
    return dealt


class Maps:
    """Kernel maps as tasks use them: landmarks times which packed rows are the exponents, and whitening."""

    def __init__(self, maps: Sequence[kernel.KernelMap]):
        self.points, self.whitening = [], []
        for m in maps:
            points, whitening, gamma = m.matrices()
            square = (points * points).sum(1)[:, None]
            self.points.append(np.ascontiguousarray(np.concatenate([2 * gamma * points, np.full_like(square, -gamma), -gamma * square], axis=1).T))
            self.whitening.append(whitening)


def values(points: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Kernel values of packed rows with a map's landmarks."""
    k = x @ points
    np.minimum(k, 0.0, out=k)
    return np.exp(k, out=k)


def _chunks(rows, n_columns: int, wanted: Sequence[int] | None = None):
    for x, y, w, part in rows:
        x, y, w, part = np.frombuffer(x).reshape(-1, n_columns), np.frombuffer(y), np.frombuffer(w), np.frombuffer(part, np.uint8)
        if wanted is not None:
            at = rows_of(part, wanted)
            x, y, w, part = x[at], y[at], w[at], part[at]
        for i in range(0, len(x), CHUNK_ROWS):
            yield tuple(v[i:i + CHUNK_ROWS] for v in (x, y, w, part))


def summed(rows: RDD, of) -> dict:
    """The sums over all tasks of the arrays that ``of`` yields by key; a few hundred numbers a key and task."""
    def run(part):
        held: dict = {}
        for key, v in of(list(part)):
            held[key] = held[key] + v if key in held else v
        return iter(held.items())
    out: dict = {}
    for key, v in rows.mapPartitions(run).collect():
        out[key] = out[key] + v if key in out else v
    return out


def _moments(maps: Maps, used: dict[int, tuple[int, ...]], n_columns: int):
    """(map, part) -> sums of w, w^2, y, w z and w z^2."""
    def of(rows):
        for i, parts in used.items():
            for x, y, w, part in _chunks(rows, n_columns, parts):
                z = values(maps.points[i], x) @ maps.whitening[i]
                for p in np.unique(part):
                    at = part == p
                    yield (i, int(p)), np.concatenate([[w[at].sum(), (w[at] ** 2).sum(), y[at].sum()], w[at] @ z[at], w[at] @ (z[at] * z[at])])
    return of


def _hinge(points: list[np.ndarray], asked: list[tuple[Machine, int, np.ndarray, float]], n_columns: int):
    """Sums of loss, of multipliers and of kernel values by them, for machines (machine, number, kernel coefficients, offset)."""
    by: dict = {}
    for a in asked:
        by.setdefault((a[0].map, a[0].train), []).append(a)
    by_map: dict = {}
    for (i, train), some in by.items():
        by_map.setdefault(i, []).append((train, some))

    def of(rows):
        for i, groups in by_map.items():
            parts = tuple(sorted({p for train, _ in groups for p in train}))
            every = [(train, *a) for train, some in groups for a in some]
            u = np.stack([a[3] for a in every], axis=1)
            offsets = np.array([a[4] for a in every])
            for x, y, w, part in _chunks(rows, n_columns, parts):
                k = values(points[i], x)
                margin = k @ u + offsets
                side = (2 * y - 1)[:, None]
                own = np.stack([np.isin(part, a[0]) for a in every], axis=1) if len(groups) > 1 else True
                loss = (1 - side * margin) * w[:, None]
                bad = (loss > 0) & own
                coef = np.where(bad, -side * w[:, None], 0.0)
                sums = np.concatenate([np.where(bad, loss, 0.0).sum(0)[None], coef.sum(0)[None], k.T @ coef])
                yield i, sums
    return of, {i: [a[1] for _, some in groups for a in some] for i, groups in by_map.items()}


def fit_machines(rows: RDD, maps: Sequence[kernel.KernelMap], machines: Sequence[Machine], max_iter: int = 50,
                 tol: float = 1e-6) -> list[tuple[np.ndarray, float]]:
    """Coefficients of kernel features and intercept of each machine."""
    packed_maps, n = Maps(maps), len(maps[0].getInputCols()) + 2
    used = {i: tuple(sorted({p for m in machines if m.map == i for p in m.train})) for i in range(len(maps))}
    moments = summed(rows, _moments(packed_maps, used, n))
    fits, total, std, scaled = [], [], [], []
    for m in machines:
        found = [moments[m.map, p] for p in m.train if (m.map, p) in moments]
        if not found or not sum(v[0] for v in found):
            raise ValueError("no rows to fit a machine on")
        v, rank = sum(found), packed_maps.whitening[m.map].shape[1]
        if not v[2]:
            raise ValueError("no row of class 1 to fit a machine on")  # as MLlib
        w, w2, first, second = v[0], v[1], v[3:3 + rank], v[3 + rank:]
        left = w - w2 / w
        var = np.maximum((second - first * first / w) / left, 0.0) if left > 0 else np.zeros(rank)
        total.append(w)
        std.append(np.sqrt(var))
        scaled.append(np.divide(first / w, std[-1], out=np.zeros(rank), where=std[-1] > 0))
        fits.append(owlqn(rank + 1, max_iter, tol))
    inverse = [np.divide(1.0, s, out=np.zeros(len(s)), where=s > 0) for s in std]
    asks, done = {j: next(f) for j, f in enumerate(fits)}, {}
    while asks:
        at = [(machines[j], j, packed_maps.whitening[machines[j].map] @ (b[:-1] * inverse[j]), float(b[-1] - b[:-1] @ scaled[j])) for j, b in asks.items()]
        of, order = _hinge(packed_maps.points, at, n)
        sums = summed(rows, of)
        for i, numbers in order.items():
            for c, j in enumerate(numbers):
                loss, coef, near = sums[i][0, c], sums[i][1, c], sums[i][2:, c]
                b, reg = asks[j], machines[j].reg
                grad = np.append(((packed_maps.whitening[i].T @ near) * inverse[j] - coef * scaled[j]) / total[j] + reg * b[:-1], coef / total[j])
                try:
                    asks[j] = fits[j].send((loss / total[j] + 0.5 * reg * float(b[:-1] @ b[:-1]), grad))
                except StopIteration as end:
                    done[j] = end.value
                    del asks[j]
    return [(done[j][:-1] * inverse[j], float(done[j][-1] - done[j][:-1] @ scaled[j])) for j in range(len(machines))]


class SearchFailed(Exception):
    pass


def owlqn(dim: int, max_iter: int, tol: float, memory: int = 10, values: int = 20) -> Generator:
    """Breeze's OWL-QN without an L1 penalty, from 0: yields points, gets (value, gradient), returns the last point."""
    x = np.zeros(dim)
    value, grad = yield x
    first, seen, history, failed_once, done = value, [math.inf], [], False, 0
    while True:
        if done >= max_iter or (len(seen) >= 2 and abs(value - max(seen)) <= tol * first) or np.linalg.norm(grad) <= max(tol * value, 1e-8):
            return x
        try:
            direction = _descent(history, grad)
            direction = np.where(direction * grad < 0, direction, 0.0)
            orthant = np.where(x != 0, np.sign(x), np.sign(-grad))
            slope, alpha, shrink = float(grad @ direction), 0.5 / np.linalg.norm(grad) if done < 1 else 1.0, 0.1 if done < 1 else 0.5
            for tries in range(TRIES):
                if tries or slope >= 0:
                    new = x + direction * alpha
                    new = np.where(np.sign(new) == orthant, new, 0.0)
                    new_value, new_grad = yield new
                    along = float(new_grad @ direction)
                # the first length is judged by the value before the step, so it always shrinks
                if (new_value if tries else value) > value + alpha * slope * 1e-4:
                    factor = shrink
                elif along < 0.9 * slope:
                    factor = 2.1
                elif along > -0.9 * slope:
                    factor = shrink
                else:
                    break
                if not 1e-10 <= alpha * factor <= 1e10:
                    raise SearchFailed
                if tries < TRIES - 1:        # the last length is taken as it is
                    alpha *= factor
            history = [(new - x, new_grad - grad), *history][:memory]
            x, value, grad, failed_once, done = new, new_value, new_grad, False, done + 1
            seen = [*seen, value][-values:]
        except SearchFailed:
            if failed_once:
                return x
            failed_once, history = True, []


def _descent(history: list[tuple[np.ndarray, np.ndarray]], grad: np.ndarray) -> np.ndarray:
    scale = 1.0
    if history:
        s, y = history[0]
        if not s @ y >= 0:
            raise SearchFailed
        scale = (s @ y) / (y @ y)
    d, kept = grad.copy(), []
    for s, y in history:
        rho = s @ y
        a = (s @ d) / rho
        if math.isnan(a):
            raise SearchFailed
        d -= a * y
        kept.append((a, rho))
    d *= scale
    for (s, y), (a, rho) in zip(reversed(history), reversed(kept), strict=True):
        d += s * (a - (y @ d) / rho)
    return -d


def sides(rows: RDD, maps: Sequence[kernel.KernelMap], fitted: Sequence[tuple[np.ndarray, float]], machines: Sequence[Machine],
          tests: Sequence[int]) -> list[np.ndarray]:
    """Of each machine on the part ``tests`` of the rows: hits, positive predictions, positive labels."""
    packed_maps, n = Maps(maps), len(maps[0].getInputCols()) + 2
    near = [packed_maps.whitening[m.map] @ b for m, (b, _) in zip(machines, fitted, strict=True)]
    points, at = packed_maps.points, {i: [j for j, m in enumerate(machines) if m.map == i] for i in range(len(maps))}

    def of(blocks):
        for i, own in at.items():
            for part in {tests[j] for j in own}:
                some = [j for j in own if tests[j] == part]
                for x, y, _, _ in _chunks(blocks, n, (part,)):
                    margin = values(points[i], x) @ np.stack([near[j] for j in some], axis=1) + np.array([fitted[j][1] for j in some])
                    said, true = margin > 0, (y == 1)[:, None]
                    for c, j in enumerate(some):
                        yield j, np.array([(said[:, c] & true[:, 0]).sum(), said[:, c].sum(), true.sum()])
    found = summed(rows, of)
    return [found.get(j, np.zeros(3)) for j in range(len(machines))]


def to_mllib(svc: LinearSVC, spark, coefficients: np.ndarray, intercept: float) -> LinearSVCModel:
    """The fitted machine as the model that ``svc`` makes."""
    sc = spark.sparkContext
    values = sc._gateway.new_array(sc._gateway.jvm.double, len(coefficients))
    for i, v in enumerate(coefficients):
        values[i] = float(v)
    ml = sc._jvm.org.apache.spark.ml
    return svc._copyValues(LinearSVCModel(ml.classification.LinearSVCModel(svc.uid, ml.linalg.Vectors.dense(values), float(intercept))))
