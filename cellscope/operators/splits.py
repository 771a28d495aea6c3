"""Chronological splits, time-series and stratified folds, class balance.

Positions come from ``with_position`` (exact, skew-safe), so a battery holding a third
of all rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscope.operators.ordering import attach_row, join_null_safe, with_position

# Split fractions and the rule-fallback floor of the reference.
TRAIN_FRACTION = 0.70
VAL_FRACTION = 0.85
MIN_POSITIVES_FOR_MODEL = 20


def chrono_split(df: DataFrame, by: Sequence[str] = ("battery_id",), order_col: str = "seq",
                 train: float = TRAIN_FRACTION, val: float = VAL_FRACTION, largest: int | None = None) -> DataFrame:
    """Positional split per group: train = [0, int(0.70 n)), val = [.., int(0.85 n)), test = rest.
    ``largest``: a known bound on the rows of a group.

    Adds ``pos``, ``n_rows``, ``split``, ``split_pos`` (position inside the split) and
    ``split_rows``. Fractions are doubles (a bare 0.70 is a decimal in Spark SQL)."""
    p = with_position(df, order_col, by, largest=largest)
    n = F.col("n_rows").cast("double")
    tr_end = F.floor(n * F.lit(float(train)))
    va_end = F.floor(n * F.lit(float(val)))
    pos = F.col("pos")
    split = F.when(pos < tr_end, "train").when(pos < va_end, "val").otherwise("test")
    start = F.when(pos < tr_end, F.lit(0)).when(pos < va_end, tr_end).otherwise(va_end)
    size = (F.when(pos < tr_end, tr_end).when(pos < va_end, va_end - tr_end)
            .otherwise(F.col("n_rows") - va_end))
    return p.select("*", split.alias("split"), (pos - start).cast("long").alias("split_pos"),
                    size.cast("long").alias("split_rows"))


def split_info(df: DataFrame, by: Sequence[str] = ("battery_id",), train: float = TRAIN_FRACTION,
               val: float = VAL_FRACTION) -> DataFrame:
    """Split bounds per group: train_end, val_end, total (counts only, no ordering needed)."""
    c = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    n = F.col("total").cast("double")
    return c.select(*by, F.floor(n * F.lit(float(train))).cast("long").alias("train_end"),
                    F.floor(n * F.lit(float(val))).cast("long").alias("val_end"), "total")


def ts_role(fold: int, k: int = 5, pos_col: str = "split_pos", count_col: str = "split_rows") -> Column:
    """The role of a row in time fold ``fold`` of k: train, test, or NULL (later rows). Plain
    arithmetic on its position, so fold loops filter on it and need no join."""
    n, p = F.col(count_col), F.col(pos_col)
    s = F.floor(n / (k + 1))
    start = n - (k - fold) * s
    return F.when(p < start, "train").when(p < start + s, "test")


def ts_folds(df: DataFrame, k: int = 5, pos_col: str = "split_pos", count_col: str = "split_rows",
             keys: Sequence[str] = ("battery_id", "seq")) -> DataFrame:
    """Expanding-window time-series folds (public TimeSeriesSplit definition): test size
    n // (k+1); fold i tests [n - (k-i) s, n - (k-i-1) s) and trains on everything before.
    A group with fewer than k + 1 rows has no test part; its rows train in every fold.
    Returns one row per (row, fold) it takes part in: keys, fold, role."""
    entries = [F.struct(F.lit(i).alias("fold"), ts_role(i, k, pos_col, count_col).alias("role")) for i in range(k)]
    x = df.select(*keys, F.explode(F.array(*entries)).alias("f"))
    return x.select(*keys, F.col("f.fold").cast("int").alias("fold"), F.col("f.role").alias("role")) \
        .where(F.col("role").isNotNull())


def shuffle_key(seed: int, cols: Sequence[str]) -> tuple:
    """Deterministic pseudo-random order: md5 of "seed-col1-col2..." (same text in any SQL engine).
    Returns (numeric key of the first 60 bits, full hex for ties)."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), h


def strat_folds(df: DataFrame, label_col: str, k: int = 5, seed: int = 42,
                id_cols: Sequence[str] = ("battery_id", "seq")) -> DataFrame:
    """Shuffled stratified folds: inside each class, rows are ordered by an md5 shuffle key and
    dealt round-robin (position % k), so every fold gets the class proportions. Adds ``fold``."""
    key, hexkey = shuffle_key(seed, id_cols)
    x = df.withColumn("_sk", key).withColumn("_sh", hexkey)
    p = with_position(x, "_sk", [label_col], pos_col="_cpos", count_col="_cn", tiebreak=["_sh"])
    return p.withColumn("fold", (F.col("_cpos") % k).cast("int")).drop("_sk", "_sh", "_cpos", "_cn")


def fold_audit_stratified(df: DataFrame, label_col: str, k: int = 5, fold_col: str = "fold") -> DataFrame:
    """Class counts per fold for test (= the fold) and train (= the others), from per-(fold,
    class) counts only; flags folds where either side lacks a class."""
    c = df.groupBy(fold_col).agg(F.count_if(F.col(label_col) == 1).alias("t_pos"),
                                 F.count_if(F.col(label_col) == 0).alias("t_neg"))
    tot = c.agg(F.sum("t_pos").alias("a_pos"), F.sum("t_neg").alias("a_neg"))
    x = attach_row(c, tot, "_t").select("*", F.col("_t.a_pos").alias("a_pos"), F.col("_t.a_neg").alias("a_neg"))
    test = x.select(F.col(fold_col).alias("fold"), F.lit("test").alias("role"),
                    F.col("t_pos").alias("n_pos"), F.col("t_neg").alias("n_neg"))
    train = x.select(F.col(fold_col).alias("fold"), F.lit("train").alias("role"),
                     (F.col("a_pos") - F.col("t_pos")).alias("n_pos"),
                     (F.col("a_neg") - F.col("t_neg")).alias("n_neg"))
    return _degenerate(test.unionByName(train))


def fold_audit(assign: DataFrame, label_col: str) -> DataFrame:
    """Class counts per (fold, role) for explicit fold assignments that carry the label (time
    folds whose ``keys`` include it), so rows with missing keys count too."""
    c = assign.groupBy("fold", "role").agg(F.count_if(F.col(label_col) == 1).alias("n_pos"),
                                      F.count_if(F.col(label_col) == 0).alias("n_neg"))
    return _degenerate(c)


def _degenerate(c: DataFrame) -> DataFrame:
    return c.withColumn("degenerate", (F.col("n_pos") == 0) | (F.col("n_neg") == 0))


def class_counts(df: DataFrame, label_col: str, split_col: str = "split") -> DataFrame:
    """Rows per (split, class), % of the split, and negatives per positive (max(pos, 1))."""
    c = df.groupBy(split_col, label_col).agg(F.count(F.lit(1)).alias("n"))
    s = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("split_n"),
                                  F.count_if(F.col(label_col) == 1).alias("pos"),
                                  F.count_if(F.col(label_col) == 0).alias("neg"))
    return join_null_safe(c, s, [split_col]).select(
        split_col, F.col(label_col).alias("label"), "n", (F.col("n") / F.col("split_n") * 100).alias("pct"),
        (F.col("neg") / F.greatest(F.col("pos"), F.lit(1))).alias("neg_per_pos"))


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """Balanced class weights n / (2 n_c), one row per class."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    tot = df.agg(F.count(F.lit(1)).alias("n"))
    return attach_row(c, tot, "_t").select(
        F.col(label_col).alias("label"), (F.col("_t.n") / (2 * F.col("n_c"))).alias("weight"))


def scale_pos_weight(df: DataFrame, label_col: str) -> DataFrame:
    """neg / max(pos, 1) as a one-row table."""
    return df.agg((F.count_if(F.col(label_col) == 0) /
                   F.greatest(F.count_if(F.col(label_col) == 1), F.lit(1))).alias("scale_pos_weight"))


def with_weight(df: DataFrame, label_col: str, weights: DataFrame, out: str = "weight") -> DataFrame:
    """Attach per-class weights as a ``weightCol`` (weights table: label, weight; one row a class). No row
    is lost: a label without a weight has a NULL weight. The weights are broadcast: a shuffle by label would
    put a class into one task."""
    w = weights.select(F.col("label").alias(label_col), F.col("weight").alias(out))
    return join_null_safe(df, F.broadcast(w), [label_col], "left")


def feasibility(df: DataFrame, flag_cols: Sequence[str],
                min_pos: int = MIN_POSITIVES_FOR_MODEL) -> DataFrame:
    """Per target flag: positives and whether a model is feasible (>= 20) or the rule is used."""
    agg = df.agg(*[F.sum(F.col(c)).cast("long").alias(c) for c in flag_cols])
    long = agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).alias("positives"))
                                          for c in flag_cols])).alias("t")).select("t.*")
    return long.withColumn("approach", F.when(F.col("positives") < min_pos, "rule").otherwise("model"))
