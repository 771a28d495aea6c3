"""Evaluation: regression metrics, confusion counts, classification reports, ROC / PR
curves and areas, threshold sweeps, model tables and selection.

Curves are built over distinct scores (``groupBy(score)`` first, so ties collapse) with
``running_totals`` in descending score order; no window ever spans all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscope.operators.ordering import running_totals

# Metric bands and threshold grids of the reference.
R2_GOOD, R2_MODERATE = 0.80, 0.60
RECALL_FLOOR = 0.85
PRECISION_MARK = 0.60
SWEEP = [0.2 + i * 0.05 for i in range(10)]  # 0.20 .. 0.65, built as 0.2 + i*0.05 in double
DEFAULT_THRESHOLD = 0.5


def _div0(a: Column, b: Column) -> Column:
    """a / b with 0 where undefined (the reference's zero_division=0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def reg_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2 (1 - SSR/SST, SST from the population variance), max error, n."""
    e = F.col(y) - F.col(yhat)
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
        F.max(F.abs(e)).alias("max_error"), F.count(F.lit(1)).alias("n"))


def mae_pct_range(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return df.agg((F.avg(F.abs(F.col(y) - F.col(yhat))) /
                   F.nullif(F.max(y) - F.min(y), F.lit(0.0)) * 100).alias("mae_pct_range"))


def residuals(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return df.withColumn("residual", F.col(y) - F.col(yhat))


def residual_summary(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Count, mean (the bias), sample std, smallest and largest residual, as one row. Rows without a truth
    or a prediction are left out. For the histogram and the ordered series of residuals see
    ``profile.histogram`` and ``profile.trend_series``."""
    r = F.col("residual")
    return residuals(df, y, yhat).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"),
                                      F.min(r).alias("min"), F.max(r).alias("max"))


def confusion(df: DataFrame, label: str = "label", prob: str = "prob", threshold: float = 0.5,
              by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN, TN at ``prob >= threshold``."""
    pred = F.coalesce(F.col(prob) >= F.lit(float(threshold)), F.lit(False))  # no score: not flagged
    pos = F.col(label) == 1
    return df.groupBy(*by).agg(F.count_if(pred & pos).alias("tp"), F.count_if(pred & ~pos).alias("fp"),
                               F.count_if(~pred & pos).alias("fn"), F.count_if(~pred & ~pos).alias("tn"))


def cls_metrics(conf: DataFrame) -> DataFrame:
    """precision, recall, F1, accuracy from confusion counts; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = _div0(tp, tp + fp), _div0(tp, tp + fn)
    return conf.select("*", p.alias("precision"), r.alias("recall")) \
        .withColumn("f1", _div0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))) \
        .withColumn("accuracy", _div0(tp + tn, tp + fp + fn + tn))


def cls_report(conf: DataFrame) -> DataFrame:
    """Per-class precision / recall / F1 / support, plus accuracy, macro and weighted averages."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p1, r1 = _div0(tp, tp + fp), _div0(tp, tp + fn)
    p0, r0 = _div0(tn, tn + fn), _div0(tn, tn + fp)
    f1 = _div0(2 * p1 * r1, p1 + r1)
    f0 = _div0(2 * p0 * r0, p0 + r0)
    s1, s0 = (tp + fn).cast("double"), (tn + fp).cast("double")
    n = s1 + s0
    acc = _div0(tp + tn, n)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        s.cast("long").alias("support"))
    none = F.lit(None).cast("double")
    rows = F.array(
        row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1), row("accuracy", none, none, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", _div0(p0 * s0 + p1 * s1, n), _div0(r0 * s0 + r1 * s1, n), _div0(f0 * s0 + f1 * s1, n), n))
    return conf.select(F.explode(rows).alias("r")).select("r.*")


def score_counts(df: DataFrame, label: str = "label", score: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score (partial aggregation collapses ties)."""
    return df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def cumulative_curve(df: DataFrame, label: str = "label", score: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score (descending): pos, neg, cumulative pos/neg at ``score >= s``, totals."""
    c = score_counts(df, label, score, by)
    return running_totals(c, score, by, {"pos": "pos", "neg": "neg"}, descending=True)


def roc_points(df: DataFrame, label: str = "label", score: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    c = cumulative_curve(df, label, score, by)
    return c.select(*by, F.col(score).alias("threshold"), F.col("cum_pos").cast("long").alias("tp"),
                    F.col("cum_neg").cast("long").alias("fp"),
                    F.try_divide(F.col("cum_pos"), F.col("tot_pos")).alias("tpr"),
                    F.try_divide(F.col("cum_neg"), F.col("tot_neg")).alias("fpr"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under the ROC curve from (0,0), ties handled as one step (equals the
    rank statistic). NULL when a group has one class only, with the reason."""
    c = cumulative_curve(df, label, score, by)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2))
    g = c.groupBy(*by).agg(area.alias("_a"), F.max("tot_pos").alias("n_pos"), F.max("tot_neg").alias("n_neg"))
    single = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    return g.select(*by, F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
                    F.when(~single, F.col("_a") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"),
                    F.when(single, F.lit("single class: ROC AUC undefined, precision uninformative"))
                    .alias("reason"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    c = cumulative_curve(df, label, score, by)
    return c.select(*by, F.col(score).alias("threshold"),
                    F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                    F.try_divide(F.col("cum_pos"), F.col("tot_pos")).alias("recall"))


def pr_nearest(curve: DataFrame, threshold: float) -> DataFrame:
    """The curve point whose threshold is nearest ``threshold`` (ties: the lower threshold)."""
    key = F.struct(F.abs(F.col("threshold") - F.lit(float(threshold))).alias("d"), F.col("threshold").alias("t"))
    pt = F.struct("threshold", "precision", "recall")
    return curve.agg(F.min_by(pt, key).alias("p")).select("p.*")


def threshold_pr(curve: DataFrame, recall_floor: float = RECALL_FLOOR) -> DataFrame:
    """Largest threshold whose recall still reaches the floor."""
    return curve.where(F.col("recall") >= recall_floor).agg(F.max("threshold").alias("threshold"))


def threshold_sweep(df: DataFrame, label: str = "label", prob: str = "prob",
                    thresholds: Sequence[float] = SWEEP, recall_floor: float = RECALL_FLOOR,
                    precision_mark: float = PRECISION_MARK, fallback: float = DEFAULT_THRESHOLD) -> DataFrame:
    """P / R / F1 at every threshold of the grid. Each row gets the number of thresholds it
    reaches, counts are taken per (bucket, class) (at most 2 (k+1) rows) and accumulated over
    that tiny table. The chosen threshold is the first max F1 with recall >= floor, else
    ``fallback``."""
    th = [float(t) for t in thresholds]
    b = sum((F.when(F.col(prob) >= F.lit(t), 1).otherwise(0) for t in th), F.lit(0))
    counts = df.select(b.alias("b"), (F.col(label) == 1).alias("is_pos")).groupBy("b").agg(
        F.count_if("is_pos").alias("pos"), F.count_if(~F.col("is_pos")).alias("neg"))
    # every (bucket, counts) row is read once per threshold: at most k x (k+1) rows
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(th)]))
    j = counts.select("*", grid.alias("g")).select("b", "pos", "neg", "g.i", "g.threshold")
    g = j.groupBy("i", "threshold").agg(
        F.sum(F.when(F.col("b") > F.col("i"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("b") > F.col("i"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("b") <= F.col("i"), F.col("pos")).otherwise(0)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    m = g.select("i", "threshold", tp.cast("long").alias("tp"), fp.cast("long").alias("fp"),
                 fn.cast("long").alias("fn"), _div0(tp, tp + fp).alias("precision"), _div0(tp, tp + fn).alias("recall"))
    m = m.withColumn("f1", _div0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    m = m.withColumn("meets_recall", F.col("recall") >= recall_floor) \
        .withColumn("meets_precision", F.col("precision") >= precision_mark)
    # the grid table has k rows: a global window over it is bounded
    w = Window.orderBy(F.col("meets_recall").desc(), F.round("f1", 12).desc(), "i")
    m = m.withColumn("_r", F.row_number().over(w))
    best = F.max(F.when((F.col("_r") == 1) & F.col("meets_recall"), F.col("threshold"))).over(Window.partitionBy())
    return m.withColumn("chosen_threshold", F.coalesce(best, F.lit(float(fallback)))) \
        .withColumn("is_best", F.col("threshold") == F.col("chosen_threshold")).drop("_r", "i")


def missed_events(df: DataFrame, label: str = "label", prob: str = "prob", threshold: float = 0.5) -> DataFrame:
    """Rows with label 1 and prediction 0; a row without a score is not flagged."""
    return df.where((F.col(label) == 1) & ~F.coalesce(F.col(prob) >= F.lit(float(threshold)), F.lit(False)))


def r2_band(r2: Column) -> Column:
    return F.when(r2 >= R2_GOOD, "good").when(r2 >= R2_MODERATE, "moderate").otherwise("weak")


def metrics_table(metrics: DataFrame) -> DataFrame:
    """Model x metric table with bands: R2 good / moderate / weak; a linear-fit R2 < .5 asks
    for a non-linear model."""
    return metrics.withColumn("r2_band", r2_band(F.col("r2"))) \
        .withColumn("needs_nonlinear", F.col("r2") < 0.5)


def learning_gap_band(train_rmse: Column, val_rmse: Column) -> Column:
    """Learning-curve diagnosis: gap > 50% of train RMSE -> overfit; train RMSE > .01 -> underfit."""
    gap = val_rmse - train_rmse
    return F.when(gap > 0.5 * train_rmse, "overfit").when(train_rmse > 0.01, "underfit").otherwise("good")


def select_regressor(metrics: DataFrame, model_col: str = "model", order_col: str = "order") -> DataFrame:
    """Lowest RMSE; ties go to the first listed (``order_col``)."""
    return metrics.agg(F.min_by(model_col, F.struct(F.col("rmse"), F.col(order_col))).alias("selected"))


def select_classifier(metrics: DataFrame, model_col: str = "model", order_col: str = "order",
                      recall_floor: float = RECALL_FLOOR) -> DataFrame:
    """Highest F1 among models with recall >= floor, else highest F1 overall; ties go to the
    first listed (``order_col``)."""
    key_ok = F.struct(F.round(F.col("f1"), 12), -F.col(order_col))
    ok = F.max_by(F.when(F.col("recall") >= recall_floor, F.col(model_col)),
                  F.when(F.col("recall") >= recall_floor, key_ok))
    anyf = F.max_by(F.col(model_col), key_ok)
    return metrics.agg(F.coalesce(ok, anyf).alias("selected"))
