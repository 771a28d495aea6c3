"""Registered queries over ``telemetry_holes``: the same operators where keys, flags and scores are
NULL, a battery has a few rows, or a column is constant."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from cellscope.functions.exprs import flag_health
from cellscope.operators import clean
from cellscope.operators import evaluate as ev
from cellscope.operators import profile as pr
from cellscope.operators import soc
from cellscope.operators import splits as sp
from cellscope.plans.profile_queries import REGIME_SQL
from cellscope.plans.registry import register
from cellscope.plans.split_queries import SPLIT_CTE, TS_FOLDS_SQL
from cellscope.sources.telemetry import telemetry_holes

H = ("telemetry_holes",)
KEYS = ["battery_id", "seq"]
COLS = ["SOC", "terminal_voltage", "internal_resistance", "battery_temp"]
PAIRS = list(combinations(COLS, 2))


def named(df, *cols):
    """Missing keys shown as -1, so that whole numbers stay whole in any client."""
    for c in cols or ("battery_id",):
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(-1).cast(df.schema[c].dataType)))
    return df


def over_holes(sql: str) -> str:
    return sql.replace("from telemetry t)", "from telemetry_holes t)").replace("from telemetry)", "from telemetry_holes)")


@register("holes_chrono_split", over_holes(SPLIT_CTE) + "\nselect coalesce(battery_id, -1) as battery_id, seq, pos, split, split_pos from sp", views=H)
def q_chrono_split(spark, sf_dir):
    return named(sp.chrono_split(telemetry_holes(spark, sf_dir))).select(*KEYS, "pos", "split", "split_pos")


@register("holes_ts_folds", over_holes(TS_FOLDS_SQL).replace(
    "select * from x", "select coalesce(battery_id, -1) as battery_id, seq, fold, role from x"), views=H)
def q_ts_folds(spark, sf_dir):
    return named(sp.ts_folds(sp.chrono_split(telemetry_holes(spark, sf_dir)).where(F.col("split") == "train")))


@register("holes_fold_audit", over_holes(TS_FOLDS_SQL).replace("select * from x where role is not null", """
select x.fold, x.role, count_if(sp.over_temp_flag = 1) as n_pos, count_if(sp.over_temp_flag = 0) as n_neg,
  (count_if(sp.over_temp_flag = 1) = 0 or count_if(sp.over_temp_flag = 0) = 0) as degenerate
from x join sp on x.battery_id is not distinct from sp.battery_id and x.seq = sp.seq where x.role is not null
group by x.fold, x.role"""), views=H)
def q_fold_audit(spark, sf_dir):
    tr = sp.chrono_split(telemetry_holes(spark, sf_dir)).where(F.col("split") == "train")
    return sp.fold_audit(sp.ts_folds(tr, keys=["over_temp_flag"]), "over_temp_flag")


@register("holes_strat_folds", """
select coalesce(battery_id, -1) as battery_id, seq, coalesce(over_temp_flag, -1) as label,
  cast((row_number() over (partition by over_temp_flag
        order by md5(concat_ws('-', '42', cast(battery_id as varchar), cast(seq as varchar)))) - 1) % 5 as integer) as fold
from telemetry_holes""", views=H)
def q_strat_folds(spark, sf_dir):
    return named(sp.strat_folds(telemetry_holes(spark, sf_dir).select(*KEYS, F.col("over_temp_flag").alias("label")), "label"), "battery_id", "label")


@register("holes_regime_runs", over_holes(REGIME_SQL).replace("select battery_id, over_temp_flag as flag",
          "select coalesce(battery_id, -1) as battery_id, coalesce(over_temp_flag, -1) as flag"), views=H)
def q_regime_runs(spark, sf_dir):
    return named(pr.regime_runs(telemetry_holes(spark, sf_dir), "over_temp_flag"), "battery_id", "flag")


@register("holes_group_dist", "\nunion all\n".join(
    f"select coalesce(over_temp_flag, -1) as over_temp_flag, '{c}' as feature, avg({c}) as mean, cast(min({c}) as double) as min, "
    f"cast(max({c}) as double) as max, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as median, "
    f"quantile_cont({c}, 0.75) as q3 from telemetry_holes group by over_temp_flag" for c in COLS),
    views=H, doubles=["mean", "min", "max", "q1", "median", "q3"])
def q_group_dist(spark, sf_dir):
    return named(pr.group_dist(telemetry_holes(spark, sf_dir), "over_temp_flag", COLS), "over_temp_flag")


@register("holes_impute_fit", "select 'empty' as feature, cast(null as double) as median\nunion all\n" + "\nunion all\n".join(
    f"select '{c}' as feature, quantile_cont({c}, 0.5) as median from telemetry_holes" for c in COLS), views=H, doubles=["median"])
def q_impute_fit(spark, sf_dir):
    """A feature without any value is reported with a NULL median."""
    t = telemetry_holes(spark, sf_dir).withColumn("empty", F.lit(None).cast("double"))
    return clean.impute_fit(t, [*COLS, "empty"])


@register("holes_corr_matrix", "\nunion all\n".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, corr({a}, {b}) as r from telemetry_holes" for a, b in PAIRS),
    views=H, doubles=["r"])
def q_corr_matrix(spark, sf_dir):
    return pr.corr_matrix(telemetry_holes(spark, sf_dir), COLS)


@register("holes_confusion", """select count_if(coalesce(prob >= 0.2e0, false) and label = 1) as tp,
  count_if(coalesce(prob >= 0.2e0, false) and label <> 1) as fp, count_if(not coalesce(prob >= 0.2e0, false) and label = 1) as fn,
  count_if(not coalesce(prob >= 0.2e0, false) and label <> 1) as tn from telemetry_holes""", views=H)
def q_confusion(spark, sf_dir):
    return ev.confusion(telemetry_holes(spark, sf_dir), threshold=0.2)


@register("holes_missed_events", "select seq from telemetry_holes where label = 1 and (prob < 0.2e0 or prob is null)", views=H)
def q_missed_events(spark, sf_dir):
    return ev.missed_events(telemetry_holes(spark, sf_dir), threshold=0.2).select("seq")


@register("holes_flag_health", "select seq, case when over_temp_flag = 0 then 100e0 else 40e0 end as thermal_health from telemetry_holes",
          views=H, doubles=["thermal_health"])
def q_flag_health(spark, sf_dir):
    return telemetry_holes(spark, sf_dir).select("seq", flag_health("over_temp_flag").alias("thermal_health"))


@register("holes_constant_bin", "select seq, 9 as soc_bin from telemetry_holes", views=H)
def q_constant_bin(spark, sf_dir):
    return soc.soc_bin(telemetry_holes(spark, sf_dir), 20, col="flat").select("seq", "soc_bin")


@register("holes_class_counts", """select coalesce(over_temp_flag, -1) as label, count(*) as n,
  sum(count(*)) over () / (2 * count(*)) as weight from telemetry_holes group by over_temp_flag""", views=H, doubles=["weight"])
def q_class_counts(spark, sf_dir):
    t = telemetry_holes(spark, sf_dir)
    x = sp.with_weight(t, "over_temp_flag", sp.class_weights(t, "over_temp_flag"))
    return x.groupBy(F.col("over_temp_flag").alias("label"), "weight").agg(F.count(F.lit(1)).alias("n"))\
        .select(F.coalesce("label", F.lit(-1)).alias("label"), "n", "weight")
