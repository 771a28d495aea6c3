"""Invariants: results do not depend on the shuffle partition count, and
fitted parameters use train rows only."""

import pytest
from pyspark.sql import functions as F

from cellscope.operators import evaluate as ev
from cellscope.operators import prep, splits
from cellscope.operators.ordering import exact_quantiles
from cellscope.sources import scores_view, telemetry
from tests.conftest import SF_SMALL


def _run(spark, parts, fn):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return fn()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_partition_count_invariance(spark, parts):
    def compute():
        s = scores_view(spark, SF_SMALL)
        auc = ev.roc_auc(s).first().roc_auc
        q = sorted((r.feature, r.p, round(r.value, 12)) for r in
                   exact_quantiles(telemetry(spark, SF_SMALL), ["SOC", "internal_resistance"], [0.1, 0.5, 0.9]).collect())
        pos = splits.chrono_split(telemetry(spark, SF_SMALL)).groupBy("split").agg(F.sum("pos")).collect()
        return round(auc, 12), q, sorted(tuple(r) for r in pos)
    base = _run(spark, 8, compute)
    assert _run(spark, parts, compute) == base


def test_params_use_train_rows_only(spark):
    s = splits.chrono_split(telemetry(spark, SF_SMALL))
    changed = s.withColumn("SOC", F.when(F.col("split") != "train", F.col("SOC") + 1000).otherwise(F.col("SOC"))) \
        .withColumn("charging_time", F.when(F.col("split") == "test", F.lit(0.0)).otherwise(F.col("charging_time")))
    a, _ = prep.prep_fit_transform(s, ["SOH"])
    b, _ = prep.prep_fit_transform(changed, ["SOH"])

    def rows(p):
        m = {r.feature: round(r.median, 9) for r in p.medians.collect()}
        st = {r.feature: (round(r.mean, 9), round(r.std, 9)) for r in p.stats.collect()}
        return m, st, round(p.baseline.first().baseline_ir, 12)
    assert rows(a) == rows(b)
