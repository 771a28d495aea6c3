"""Registered queries that hold parts of the model results against SQL: what a fit must keep
whatever its numbers are (keys, folds, rules, row counts, differences after reloading)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscope.operators import splits, train
from cellscope.operators.ordering import checkpointed
from cellscope.plans import model_queries as mq
from cellscope.plans.registry import register
from cellscope.plans.split_queries import SPLIT_CTE, STRAT_SQL
from cellscope.session import scratch_path
from cellscope.sources import files

VOLTAGE = "case when action_voltage > 4.15e0 or terminal_voltage > 4.18e0 then 1 else 0 end"


@register("sink_csv", f"select battery_id, seq, {VOLTAGE} as pred_over_voltage_flag from telemetry")
def q_sink_csv(spark, sf_dir):
    """Scored rows written as CSV and read back: all of them, with the rule's flag."""
    path = files.write_csv(mq.q_predict_batch(spark, sf_dir), scratch_path(spark, "scored-csv"))
    back = spark.read.option("header", True).csv(path)
    return back.where("pred_internal_resistance is not null and cast(pred_over_temp_prob as double) between 0 and 1").select(
        F.col("battery_id").cast("long").alias("battery_id"), F.col("seq").cast("long").alias("seq"),
        F.col("pred_over_voltage_flag").cast("int").alias("pred_over_voltage_flag"))


@register("model_io_check", SPLIT_CTE + "\nselect count(*) as n_rows, 0e0 as largest_difference from sp where split = 'val'",
          doubles=["largest_difference"])
def q_model_io_check(spark, sf_dir):
    """A reloaded model gives the same predictions."""
    reg, _ = mq._models(spark, sf_dir)
    back = files.load_model(files.save_model(reg, scratch_path(spark, "model-check")))
    _, va, _ = mq.parts(spark, sf_dir)
    once = reg.transform(va).withColumnRenamed("prediction", "first").drop("features")
    return back.transform(once).agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("prediction") - F.col("first"))).alias("largest_difference"))


@register("oof_folds_check", STRAT_SQL)
def q_oof_folds_check(spark, sf_dir):
    """Out-of-fold predictions cover each training row once, in its own fold."""
    tr, _, _ = mq.parts(spark, sf_dir)
    f = checkpointed(splits.strat_folds(tr, "over_temp_flag"))  # five fits and scorings read it
    got = train.oof_predict(f, mq.CLS_FEATURES, "over_temp_flag", weight_col="w_temp", maxIter=5)
    return got.where("prob between 0 and 1").select("battery_id", "seq", F.col("over_temp_flag").alias("label"), "fold")


@register("importance_check", f"select {len(mq.REG_FEATURES)} as n_features, {len(mq.REG_FEATURES) * (len(mq.REG_FEATURES) + 1) // 2} as rank_sum, 1e0 as share_sum",
          doubles=["share_sum"])
def q_importance_check(spark, sf_dir):
    """Importances rank each feature once and sum to one."""
    got = mq.q_feature_importance(spark, sf_dir)
    return got.agg(F.count_distinct("feature").cast("int").alias("n_features"), F.sum("rank").cast("int").alias("rank_sum"),
                   F.sum("importance").alias("share_sum"))


@register("linear_residuals_check", SPLIT_CTE + "\nselect count(*) as n_rows, 0e0 as mean_residual from sp where split = 'train'",
          doubles=["mean_residual"])
def q_linear_residuals_check(spark, sf_dir):
    """Residuals of least squares with an intercept have mean zero on the training rows."""
    reg, _ = mq._models(spark, sf_dir)
    tr, _, _ = mq.parts(spark, sf_dir)
    return reg.transform(tr).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(mq.Y) - F.col("prediction")).alias("mean_residual"))


@register("logistic_residuals_check", SPLIT_CTE + "\nselect count(*) as n_rows, cast(count(*) as double) as weight_sum, 0e0 as mean_residual from sp where split = 'train'",
          doubles=["weight_sum", "mean_residual"], digits=4)
def q_logistic_residuals_check(spark, sf_dir):
    """Balanced weights sum to the rows, and at the optimum of a logistic fit with a free intercept the
    weighted residuals of the training rows have mean zero."""
    _, cls = mq._models(spark, sf_dir)
    tr, _, _ = mq.parts(spark, sf_dir)
    p = train.positive_prob(cls.transform(tr))
    residual = F.col("w_temp") * (F.col("over_temp_flag") - F.col("prob"))
    return p.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("w_temp").alias("weight_sum"),
                 (F.sum(residual) / F.sum("w_temp")).alias("mean_residual"))


@register("learning_curve_rows", SPLIT_CTE + """
, tr as (select split_pos, split_rows - 5 * (split_rows // 6) as first_train from sp where split = 'train')
select f.i / 10e0 as fraction, cast(count(*) as bigint) as train_rows
from tr cross join range(1, 11) f(i) where split_pos < floor(first_train * (f.i / 10e0)) group by f.i""", doubles=["fraction"])
def q_learning_curve_rows(spark, sf_dir):
    """The rows that each learning-curve prefix trains on."""
    tr, _, _ = mq.parts(spark, sf_dir)
    fits = [F.when(train.curve_prefix(i / 10), F.lit(i / 10)) for i in range(1, 11)]
    return tr.select(F.explode(F.array_compact(F.array(*fits))).alias("fraction")).groupBy("fraction").agg(F.count(F.lit(1)).alias("train_rows"))
