"""Registered queries: splits, folds, class balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscope.operators import splits as sp
from cellscope.operators.ordering import checkpointed
from cellscope.plans.registry import register
from cellscope.sources.telemetry import telemetry

KEYS = ["battery_id", "seq"]

SPLIT_CTE = """, p as (
  select t.*, row_number() over (partition by battery_id order by seq) - 1 as pos,
    count(*) over (partition by battery_id) as n_rows
  from telemetry t)
, sp as (
  select p.*,
    case when pos < floor(n_rows * 0.70e0) then 'train' when pos < floor(n_rows * 0.85e0) then 'val'
         else 'test' end as split,
    cast(pos - case when pos < floor(n_rows * 0.70e0) then 0 when pos < floor(n_rows * 0.85e0)
         then floor(n_rows * 0.70e0) else floor(n_rows * 0.85e0) end as bigint) as split_pos,
    cast(case when pos < floor(n_rows * 0.70e0) then floor(n_rows * 0.70e0)
         when pos < floor(n_rows * 0.85e0) then floor(n_rows * 0.85e0) - floor(n_rows * 0.70e0)
         else n_rows - floor(n_rows * 0.85e0) end as bigint) as split_rows
  from p)"""


def split_frame(spark, sf_dir):
    return sp.chrono_split(telemetry(spark, sf_dir))


def train_rows(spark, sf_dir):
    return split_frame(spark, sf_dir).where(F.col("split") == "train")


@register("chrono_split", SPLIT_CTE + "\nselect battery_id, seq, pos, split, split_pos from sp")
def q_chrono_split(spark, sf_dir):
    return split_frame(spark, sf_dir).select(*KEYS, "pos", "split", "split_pos")


@register("split_info", """select battery_id, cast(floor(count(*) * 0.70e0) as bigint) as train_end,
  cast(floor(count(*) * 0.85e0) as bigint) as val_end, count(*) as total
from telemetry group by battery_id""")
def q_split_info(spark, sf_dir):
    return sp.split_info(telemetry(spark, sf_dir))


TS_FOLDS_SQL = SPLIT_CTE + """
, tr as (select battery_id, seq, split_pos, split_rows, split_rows // 6 as s from sp where split = 'train')
, x as (
  select battery_id, seq, cast(f.i as integer) as fold,
    case when split_pos < split_rows - (5 - f.i) * s then 'train'
         when split_pos < split_rows - (5 - f.i) * s + s then 'test' end as role
  from tr cross join range(0, 5) f(i))
select * from x where role is not null"""


@register("ts_folds", TS_FOLDS_SQL)
def q_ts_folds(spark, sf_dir):
    return sp.ts_folds(train_rows(spark, sf_dir))


STRAT_SQL = SPLIT_CTE + """
select battery_id, seq, over_temp_flag as label,
  cast((row_number() over (partition by over_temp_flag
        order by md5(concat_ws('-', '42', cast(battery_id as varchar), cast(seq as varchar)))) - 1) % 5 as integer) as fold
from sp where split = 'train'"""


@register("strat_folds", STRAT_SQL)
def q_strat_folds(spark, sf_dir):
    t = train_rows(spark, sf_dir).select(*KEYS, F.col("over_temp_flag").alias("label"))
    return sp.strat_folds(t, "label")


_STRAT_BODY = STRAT_SQL[len(SPLIT_CTE):]
_TS_BODY = TS_FOLDS_SQL[len(SPLIT_CTE):]
FOLD_AUDIT_SQL = SPLIT_CTE + "\n, sf as (" + _STRAT_BODY + ")\n, tf as (select * from (" + \
    _TS_BODY.replace(", tr as", "with tr as", 1) + """))
, sc as (select fold, count_if(label = 1) as t_pos, count_if(label = 0) as t_neg from sf group by fold)
, st as (select sum(t_pos) as a_pos, sum(t_neg) as a_neg from sc)
, a as (
  select 'stratified' as kind, fold, 'test' as role, t_pos as n_pos, t_neg as n_neg from sc
  union all
  select 'stratified', fold, 'train', cast(a_pos - t_pos as bigint), cast(a_neg - t_neg as bigint) from sc cross join st
  union all
  select 'time', tf.fold, tf.role, count_if(sp.over_temp_flag = 1), count_if(sp.over_temp_flag = 0)
  from tf join sp using (battery_id, seq) group by tf.fold, tf.role)
select a.*, (n_pos = 0 or n_neg = 0) as degenerate from a"""


@register("fold_audit", FOLD_AUDIT_SQL)
def q_fold_audit(spark, sf_dir):
    # folds and audits read the train rows several times: split and number them once
    tr = checkpointed(train_rows(spark, sf_dir).select(*KEYS, "over_temp_flag", "split_pos", "split_rows"))
    lab = tr.select(*KEYS, F.col("over_temp_flag").alias("label"))
    strat = sp.fold_audit_stratified(sp.strat_folds(lab, "label"), "label")
    time = sp.fold_audit(sp.ts_folds(tr, keys=["over_temp_flag"]), "over_temp_flag")
    cols = ["fold", "role", "n_pos", "n_neg", "degenerate"]
    return strat.select(F.lit("stratified").alias("kind"), *cols) \
        .unionByName(time.select(F.lit("time").alias("kind"), *cols))


@register("class_counts", SPLIT_CTE + """
, c as (select split, over_temp_flag as label, count(*) as n from sp group by split, over_temp_flag)
, s as (select split, count(*) as split_n, count_if(over_temp_flag = 1) as pos,
          count_if(over_temp_flag = 0) as neg from sp group by split)
select split, label, n, n / split_n * 100 as pct, neg / greatest(pos, 1) as neg_per_pos
from c join s using (split)""", doubles=["pct", "neg_per_pos"])
def q_class_counts(spark, sf_dir):
    return sp.class_counts(split_frame(spark, sf_dir), "over_temp_flag")


@register("class_weights", SPLIT_CTE + """
, tr as (select * from sp where split = 'train')
select over_temp_flag as label, (select count(*) from tr) / (2 * count(*)) as weight
from tr group by over_temp_flag""", doubles=["weight"])
def q_class_weights(spark, sf_dir):
    return sp.class_weights(train_rows(spark, sf_dir), "over_temp_flag")


@register("scale_pos_weight", SPLIT_CTE + """
select count_if(over_temp_flag = 0) / greatest(count_if(over_temp_flag = 1), 1) as scale_pos_weight
from sp where split = 'train'""", doubles=["scale_pos_weight"])
def q_scale_pos_weight(spark, sf_dir):
    return sp.scale_pos_weight(train_rows(spark, sf_dir), "over_temp_flag")


@register("feasibility", SPLIT_CTE + """
, s as (select cast(sum(over_temp_flag) as bigint) as a, cast(sum(over_voltage_flag) as bigint) as b
        from sp where split = 'train')
select 'over_temp_flag' as target, a as positives, case when a < 20 then 'rule' else 'model' end as approach from s
union all
select 'over_voltage_flag', b, case when b < 20 then 'rule' else 'model' end from s""")
def q_feasibility(spark, sf_dir):
    return sp.feasibility(train_rows(spark, sf_dir), ["over_temp_flag", "over_voltage_flag"])
