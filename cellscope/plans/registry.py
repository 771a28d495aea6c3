"""Query registry: name -> (Spark builder, DuckDB oracle SQL, rounded double columns).

Every double column of a registered result is rounded in both the Spark result and the
oracle (6 digits unless stated, 12 for slopes), because summation order differs between
engines; counts stay bigint.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellscope.plans.views import rounded, with_views


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    body: str | None
    views: tuple
    digits: dict[str, int] = field(default_factory=dict)

    @property
    def sql(self) -> str | None:
        if self.body is None:
            return None
        return rounded(with_views(bigint_counts(self.body), self.views), self.digits)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return finalize(self.build(spark, sf_dir), self.digits)


REGISTRY: dict[str, Query] = {}


def bigint_counts(sql: str) -> str:
    """Wrap every ``count_if(...)`` in ``cast(... as bigint)``: DuckDB widens it to a 128-bit
    integer, Spark returns bigint."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        inner = bigint_counts(sql[j + len(key):k])
        out.append(sql[i:j] + "cast(count_if(" + inner + ") as bigint)")
        i = k + 1


def register(name: str, sql: str | None = None, views=("telemetry",), doubles=(), digits=6,
             special: dict[str, int] | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    dig = {c: digits for c in doubles}
    dig.update(special or {})

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(views), dig)
        return fn
    return deco


def finalize(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round double columns (declared digits, else 6); + 0.0 normalizes -0.0."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append((F.round(F.col(f.name), digits.get(f.name, 6)) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
