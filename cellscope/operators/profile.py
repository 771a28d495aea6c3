"""Profiling and statistics: shape, extended describe, skew, value counts, histograms,
box statistics, group distributions, correlations, trends and regime runs.

Whole-table statistics are single aggregation passes; exact percentiles use
``exact_quantiles`` (distributed, no group gathered in one task)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellscope.functions.exprs import adjusted_skew
from cellscope.operators.clean import long_table
from cellscope.operators.ordering import attach_row, exact_quantiles, join_null_safe, with_position

# Thresholds and pairs of the reference's analysis.
DESCRIBE_PERCENTILES = [0.01, 0.25, 0.5, 0.75, 0.99]
HIGH_CORR = 0.85
REDUNDANT_CORR = 0.95
WEAK_CORR = 0.03
CHOSEN_PAIRS = [("battery_temp", "thermal_stress_index"), ("SOH", "aging_indicator")]
WHISKER = 1.5


def _pname(p: float) -> str:
    return f"p{round(p * 100):d}"


def table_shape(df: DataFrame) -> DataFrame:
    """Row count, column count and one row per column with its type."""
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    cols = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                     F.lit(f.dataType.simpleString()).alias("dtype")) for i, f in enumerate(df.schema.fields)]
    return n.select("n_rows", F.lit(len(df.columns)).alias("n_cols"), F.explode(F.array(*cols)).alias("c")) \
        .select("c.position", "c.column_name", "c.dtype", "n_rows", "n_cols")


def describe_ext(df: DataFrame, cols: Sequence[str], percentiles: Sequence[float] = DESCRIBE_PERCENTILES) -> DataFrame:
    """count, mean, sample std, min, exact percentiles, max and range per column."""
    row = df.agg(*[a for c in cols for a in (
        F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
        F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max"))])
    base = long_table(row, cols, ["count", "mean", "std", "min", "max"])
    q = exact_quantiles(df, cols, percentiles)
    qw = q.groupBy("feature").pivot("p", [float(p) for p in percentiles]).agg(F.first("value"))
    qw = qw.select("feature", *[F.col(f"`{float(p)}`").alias(_pname(p)) for p in percentiles])
    out = base.join(qw, "feature", "left")
    return out.select("feature", "count", "mean", "std", "min", *[_pname(p) for p in percentiles], "max",
                      (F.col("max") - F.col("min")).alias("range"))


def skewness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bias-corrected sample skewness per column (Spark's ``skewness`` is the population g1)."""
    row = df.agg(*[a for c in cols for a in (F.skewness(c).alias(f"{c}__g1"), F.count(c).alias(f"{c}__n"))])
    long = long_table(row, cols, ["g1", "n"])
    return long.select("feature", adjusted_skew("g1", "n").alias("skew"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Frequency of each value per column (feature, value, count), most frequent first."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                             for c in cols])).alias("kv")
    return df.select(kv).groupBy("kv.feature", "kv.value").agg(F.count(F.lit(1)).alias("count")) \
        .orderBy(F.col("count").desc(), "feature", "value")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max]: bins half-open, the last one closed; empty bins
    are reported with count 0."""
    mm = df.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"))
    x = attach_row(df.select(col).where(F.col(col).isNotNull()), mm, "_mm") \
        .select(col, F.col("_mm._lo").alias("_lo"), F.col("_mm._hi").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    b = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(col) - F.col("_lo"), width) * bins)).cast("int")
    counts = x.select(F.coalesce(b, F.lit(0)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = attach_row(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")), mm, "_mm") \
        .select("bin", F.col("_mm._lo").alias("_lo"), F.col("_mm._hi").alias("_hi"))
    out = grid.join(counts, "bin", "left")  # bins rows on both sides
    return out.select("bin", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / bins).alias("bin_lo"),
                      (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("bin") + 1) / bins).alias("bin_hi"),
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def box_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Quartiles, IQR, 1.5 IQR whiskers and the outlier count per column."""
    q = exact_quantiles(df, cols, [0.25, 0.75])
    w = q.groupBy("feature").pivot("p", [0.25, 0.75]).agg(F.first("value")) \
        .select("feature", F.col("`0.25`").alias("q1"), F.col("`0.75`").alias("q3"))
    w = w.select("*", (F.col("q3") - F.col("q1")).alias("iqr")) \
        .select("*", (F.col("q1") - WHISKER * F.col("iqr")).alias("lower"),
                (F.col("q3") + WHISKER * F.col("iqr")).alias("upper"))
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                             for c in cols])).alias("kv")
    long = df.select(kv).select("kv.*")
    outl = long.join(F.broadcast(w.select("feature", "lower", "upper")), "feature") \
        .groupBy("feature").agg(F.count_if((F.col("value") < F.col("lower")) |
                                           (F.col("value") > F.col("upper"))).alias("n_outliers"))
    return w.join(outl, "feature", "left").select("feature", "q1", "q3", "iqr", "lower", "upper",
                                                  F.coalesce("n_outliers", F.lit(0)).alias("n_outliers"))


def group_dist(df: DataFrame, group_col: str, cols: Sequence[str]) -> DataFrame:
    """Per class of ``group_col``: mean, min, max, median and quartiles of each column."""
    row = df.groupBy(group_col).agg(*[a for c in cols for a in (
        F.avg(c).alias(f"{c}__mean"), F.min(c).cast("double").alias(f"{c}__min"),
        F.max(c).cast("double").alias(f"{c}__max"))])
    structs = [F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{n}").alias(n) for n in ("mean", "min", "max")])
               for c in cols]
    base = row.select(group_col, F.explode(F.array(*structs)).alias("s")).select(group_col, "s.*")
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], by=[group_col])
    qw = q.groupBy(group_col, "feature").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("value")) \
        .select(group_col, "feature", F.col("`0.25`").alias("q1"), F.col("`0.5`").alias("median"),
                F.col("`0.75`").alias("q3"))
    return join_null_safe(base, qw, [group_col, "feature"], "left")


def corr_matrix(df: DataFrame, cols: Sequence[str], wide_at: int = 40) -> DataFrame:
    """Pearson r for every pair i < j (in column order), over the rows that have both values.

    One aggregation pass of ``corr`` with partial sums. A wide table without a NULL in these
    columns, for which every pair has all rows, takes MLlib's one pass over vectors instead: the
    same numbers without hundreds of aggregates in a plan. The p x p result is bounded by the
    column list."""
    pairs = list(combinations(cols, 2))
    some_null = F.bool_or(F.greatest(*[F.col(c).isNull() for c in cols])) if len(cols) > 1 else F.lit(False)
    if len(pairs) <= wide_at or df.agg(some_null).first()[0] is not False:
        return pair_corr(df, pairs)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    v = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(
        df.select(*[F.col(c).cast("double").alias(c) for c in cols])).select("_v")
    m = Correlation.corr(v, "_v").first()[0].toArray()
    rows = [(a, b, None if m[i][j] != m[i][j] else float(m[i][j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def high_corr_pairs(corr: DataFrame, threshold: float = HIGH_CORR) -> DataFrame:
    return corr.where(F.abs("r") > threshold)


def pair_corr(df: DataFrame, pairs: Sequence[tuple[str, str]] = CHOSEN_PAIRS) -> DataFrame:
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"r{i}").alias("r"))
               for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def redundancy_rule(pairs: DataFrame, threshold: float = REDUNDANT_CORR) -> DataFrame:
    """abs(r) > 0.95: drop the first feature of the pair, keep the second."""
    return pairs.withColumn("drop_feature", F.when(F.abs("r") > threshold, F.col("feature_a")))


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """abs Pearson r of each feature with the target, ranked (1 = strongest)."""
    cols = [c for c in cols if c != target]
    row = df.agg(*[F.corr(c, target).alias(f"r{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("feature"), F.abs(F.col(f"r{i}")).alias("abs_r")) for i, c in enumerate(cols)]
    long = row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    # a tiny aggregated table (one row per feature): a global window here is bounded
    key = F.round("abs_r", 12)  # equal to 12 digits counts as a tie, broken by name
    return long.withColumn("rank", F.row_number().over(Window.orderBy(key.desc_nulls_last(), "feature")))


def weak_features(ranked: DataFrame, threshold: float = WEAK_CORR) -> DataFrame:
    return ranked.where(F.col("abs_r") < threshold)


def trend_series(df: DataFrame, cols: Sequence[str], n_points: int | None = None, order_col: str = "seq",
                 by: Sequence[str] = ()) -> DataFrame:
    """The ordered series, one point a row. With ``n_points`` it is reduced to so many position
    buckets (mean per bucket), so a plot of any length stays bounded."""
    p = with_position(df.select(*by, order_col, *cols), order_col, by)
    if n_points is None:
        return p.select(*by, F.col("pos").cast("long").alias("point"), F.col(order_col).alias("seq_from"),
                        F.col(order_col).alias("seq_to"), F.lit(1).cast("long").alias("n"), *[F.col(c).cast("double").alias(c) for c in cols])
    b = F.floor(F.col("pos") * n_points / F.col("n_rows")).cast("long")
    return p.groupBy(*by, b.alias("point")).agg(
        F.min(order_col).alias("seq_from"), F.max(order_col).alias("seq_to"), F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(c) for c in cols])


def regime_runs(df: DataFrame, flag_col: str, by: Sequence[str] = ("battery_id",),
                order_col: str = "seq") -> DataFrame:
    """Runs of equal flag value (gaps and islands): run id = position in the sequence minus
    position among rows with the same flag. Returns by..., flag, start, end, length."""
    by = list(by)
    p = with_position(df.select(*by, order_col, flag_col), order_col, by, pos_col="_p", count_col="_n")
    q = with_position(p, order_col, [*by, flag_col], pos_col="_pf", count_col="_nf")
    g = q.groupBy(*by, flag_col, (F.col("_p") - F.col("_pf")).alias("_island")).agg(
        F.min(order_col).alias("start_seq"), F.max(order_col).alias("end_seq"),
        F.min("_p").alias("start_pos"), F.count(F.lit(1)).alias("length"))
    return g.select(*by, F.col(flag_col).alias("flag"), "start_seq", "end_seq", "start_pos", "length")
