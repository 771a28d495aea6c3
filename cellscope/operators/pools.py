"""Driver calls that each start Spark jobs (fits of folds, points of a grid), several at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")
FITS_AT_ONCE = 4
POOL = "spark.scheduler.pool"


def at_once(spark: SparkSession, calls: Sequence[Callable[[], T]], threads: int = FITS_AT_ONCE) -> list[T]:
    """Results of ``calls`` in their order, with at most ``threads`` running. Each thread submits to
    a scheduler pool of its own, so with ``spark.scheduler.mode`` FAIR a long fit does not hold back
    the jobs of the others. The first failure is raised and calls that have not begun are dropped."""
    if threads <= 1 or len(calls) <= 1:
        return [c() for c in calls]
    sc = spark.sparkContext

    @inheritable_thread_target(spark)
    def run(i: int, call: Callable[[], T]) -> T:
        before = sc.getLocalProperty(POOL)
        sc.setLocalProperty(POOL, f"fits-{i % threads}")
        try:
            return call()
        finally:
            sc.setLocalProperty(POOL, before)

    pool = ThreadPoolExecutor(threads, thread_name_prefix="fits")
    try:
        return [f.result() for f in [pool.submit(run, i, c) for i, c in enumerate(calls)]]
    finally:
        pool.shutdown(wait=True, cancel_futures=True)
