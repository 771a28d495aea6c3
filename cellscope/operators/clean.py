"""Cleaning, deduplication, imputation and scaling.

Fitted values are long parameter tables (feature, value...) computed on train rows
only and applied as literals (one value per feature: bounded by the feature list, never by
the data).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscope.operators.ordering import exact_quantiles


def long_table(row: DataFrame, cols: Sequence[str], names: Sequence[str], key: str = "feature") -> DataFrame:
    """Unpivot a one-row wide result whose columns are ``{col}__{name}`` into
    (feature, name...) rows."""
    structs = [F.struct(F.lit(c).alias(key), *[F.col(f"{c}__{n}").alias(n) for n in names]) for c in cols]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def null_audit(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL count and % per column (only columns with NULLs), and the total NULL count."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in cols])
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__nulls").alias("null_count")) for c in cols]
    tot = sum((F.col(f"{c}__nulls") for c in cols), F.lit(0))
    x = row.select("_n", tot.alias("total_nulls"), F.explode(F.array(*structs)).alias("s"))
    return x.select("s.column_name", "s.null_count", (F.col("s.null_count") / F.col("_n") * 100).alias("null_pct"),
                    "total_nulls").where(F.col("null_count") > 0)


def dup_count(df: DataFrame, ignore: Sequence[str] = ("seq",)) -> DataFrame:
    """Rows that repeat an earlier row in every column but the ignored ones (one row)."""
    cols = [c for c in df.columns if c not in ignore]
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.sum("c").alias("n_rows"), F.sum(F.col("c") - 1).alias("n_duplicates"))


def dedup_first(df: DataFrame, order_col: str = "seq") -> DataFrame:
    """Drop exact repeats (all columns but ``order_col``), keeping the first occurrence:
    ``groupBy(all).agg(min(seq))``. A group of many copies is combined map-side."""
    cols = [c for c in df.columns if c != order_col]
    return df.groupBy(*cols).agg(F.min(order_col).alias(order_col)).select(*df.columns)


def impute_fit(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact median per feature on train rows: (feature, median). A feature without any value has
    a NULL median, see ``empty_features``."""
    q = exact_quantiles(train, cols, [0.5])
    every = train.sparkSession.createDataFrame([(c,) for c in cols], "feature string")  # one row a feature
    return every.join(q, "feature", "left").select("feature", F.col("value").alias("median"))


def empty_features(medians: DataFrame) -> list[str]:
    """Features without any train value: they cannot be imputed, and no fit can use them."""
    return sorted(r["feature"] for r in medians.where(F.col("median").isNull()).collect())  # at most one row a feature


def fitted_values(params: DataFrame, name: str, cols: Sequence[str], absent: float | None = None) -> dict[str, Column]:
    """The fitted value of each feature (at most one row a feature) as a literal, ``absent`` where it has none.
    Read from an attached row instead, the values of some twenty features make the code of one
    projection longer than the JVM compiles."""
    got = {r["feature"]: r[name] for r in params.where(F.col("feature").isin(list(cols))).select("feature", name).collect()}
    return {c: F.lit(v).cast("double") for c in cols for v in [got.get(c, absent)]}


def impute_apply(df: DataFrame, medians: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill NULLs with the train medians (NaN was turned into NULL at the source). A feature whose
    median is NULL keeps its NULLs; the preprocessing step leaves such features out."""
    med = fitted_values(medians, "median", cols)
    return df.select(*[F.coalesce(F.col(c), med[c]).alias(c) if c in med else F.col(c) for c in df.columns])


def scale_fit(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population std per feature on train rows: (feature, mean, std)."""
    row = train.agg(*[a for c in cols for a in (F.avg(c).alias(f"{c}__mean"),
                                                   F.stddev_pop(c).alias(f"{c}__std"))])
    return long_table(row, cols, ["mean", "std"])


def scale_apply(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """z = (x - mean) / std, with std 0 (or NULL) treated as 1."""
    stds = stats.select("feature", F.coalesce(F.nullif("std", F.lit(0.0)), F.lit(1.0)).alias("std"))
    m, s = fitted_values(stats, "mean", cols), fitted_values(stds, "std", cols, 1.0)
    return df.select(*[((F.col(c) - m[c]) / s[c]).alias(c) if c in m else F.col(c) for c in df.columns])


def scale_check(scaled: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of each scaled column (about 0 on train rows): (feature, mean)."""
    row = scaled.agg(*[F.avg(c).alias(f"{c}__mean") for c in cols])
    return long_table(row, cols, ["mean"])


def log1p_target(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"log1p_{col}", F.log1p(col))


def expm1_inverse(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"expm1_{col}", F.expm1(col))
