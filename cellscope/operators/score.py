"""Batch scoring and assessment: predictions, thresholds, voltage rule, then fleet insights
for every scored reading as one job."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cellscope.functions.exprs import over_voltage_of, temp_flag
from cellscope.operators import fleet as fl
from cellscope.operators import prep

DROP_BEFORE_SCORING = ["cycle_degradation", "over_temp_flag", "over_voltage_flag"]


def predict_batch(df: DataFrame, params: prep.PrepParams, regressor: PipelineModel, classifier: PipelineModel,
                  reg_features, cls_features, threshold: float = 0.5, keys=("battery_id", "seq")) -> DataFrame:
    """Drop targets (IR is kept: features need it), transform with the train parameters, append
    ``pred_internal_resistance``, ``pred_over_temp_prob``, ``pred_over_temp_flag`` and the rule
    ``pred_over_voltage_flag``. The original columns ride along through the transform (no
    join back to the input)."""
    base = df.drop(*[c for c in DROP_BEFORE_SCORING if c in df.columns])
    orig = [c for c in base.columns if c not in keys]
    carried = base.select("*", *[F.col(c).alias(f"_orig_{c}") for c in orig])
    feats = sorted(set(reg_features) | set(cls_features))
    x = prep.prep_transform(carried, params, feats, keys, passthrough=[f"_orig_{c}" for c in orig])
    r = regressor.transform(x).withColumnRenamed("prediction", "pred_internal_resistance").drop("features")
    c = classifier.transform(r)
    c = c.withColumn("pred_over_temp_prob", vector_to_array("probability")[1])
    out = c.select(*keys, *[F.col(f"_orig_{o}").alias(o) for o in orig], "pred_internal_resistance",
                   "pred_over_temp_prob", temp_flag("pred_over_temp_prob", threshold).alias("pred_over_temp_flag"))
    return out.withColumn("pred_over_voltage_flag", over_voltage_of(out))


def score_and_assess(scored: DataFrame, fleet: DataFrame) -> DataFrame:
    """Predictions -> health (predicted IR and flags) -> alerts -> fleet comparison -> RUL
    (fleet rate, as the assessment form does) -> recommendations."""
    kw = dict(ir_col="pred_internal_resistance", temp_flag_col="pred_over_temp_flag",
              volt_flag_col="pred_over_voltage_flag")
    h = fl.health(scored, fleet, keep_fleet=True, **kw)  # the fleet row is attached once
    a = fl.alerts(h, fleet, keep_fleet=True, **kw)
    c = fl.fleet_compare(a, fleet, ir_col="pred_internal_resistance", prob_col="pred_over_temp_prob", keep_fleet=True)
    r = fl.rul_fleet(c, fleet, ir_col="pred_internal_resistance")
    return fl.recommendations(r)
