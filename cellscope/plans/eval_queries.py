"""Registered queries: evaluation on the model-free ``scores`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscope.operators import evaluate as ev
from cellscope.operators import profile as pr
from cellscope.operators import splits as sp
from cellscope.operators.ordering import attach_row
from cellscope.plans.registry import register
from cellscope.plans.split_queries import SPLIT_CTE
from cellscope.sources.telemetry import scores_view, telemetry

KEYS = ["battery_id", "seq"]
TH = 0.2
S = ("scores",)


def scores(spark, sf_dir):
    return scores_view(spark, sf_dir)


REG_SQL = """select avg(abs(y - yhat)) as mae, sqrt(avg((y - yhat) * (y - yhat))) as rmse,
  1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(y)) as r2, max(abs(y - yhat)) as max_error, count(*) as n"""


@register("reg_metrics", REG_SQL + " from scores", views=S, doubles=["mae", "rmse", "r2", "max_error"])
def q_reg_metrics(spark, sf_dir):
    return ev.reg_metrics(scores(spark, sf_dir))


@register("mae_pct_range", "select avg(abs(y - yhat)) / nullif(max(y) - min(y), 0) * 100 as mae_pct_range from scores",
          views=S, doubles=["mae_pct_range"])
def q_mae_pct_range(spark, sf_dir):
    return ev.mae_pct_range(scores(spark, sf_dir))


@register("residuals", "select battery_id, seq, y - yhat as residual from scores", views=S, doubles=["residual"])
def q_residuals(spark, sf_dir):
    return ev.residuals(scores(spark, sf_dir)).select(*KEYS, "residual")


@register("residual_summary", """select count(y - yhat) as n, avg(y - yhat) as mean, stddev_samp(y - yhat) as std,
  min(y - yhat) as min, max(y - yhat) as max from scores""", views=S, doubles=["mean", "std", "min", "max"], digits=9)
def q_residual_summary(spark, sf_dir):
    return ev.residual_summary(scores(spark, sf_dir))


@register("residual_histogram", """, r as (select y - yhat as residual from scores)
, mm as (select min(residual) as lo, max(residual) as hi from r)
, c as (select cast(least(29, floor((residual - lo) / (hi - lo) * 30)) as integer) as bin, count(*) as n
  from r cross join mm where residual is not null group by 1)
select cast(g.bin as integer) as bin, lo + (hi - lo) * g.bin / 30 as bin_lo, lo + (hi - lo) * (g.bin + 1) / 30 as bin_hi,
  coalesce(n, 0) as count
from range(30) g(bin) cross join mm left join c on c.bin = g.bin""", views=S, doubles=["bin_lo", "bin_hi"], digits=9)
def q_residual_histogram(spark, sf_dir):
    return pr.histogram(ev.residuals(scores(spark, sf_dir)), "residual", 30)


@register("residual_series", """select battery_id, row_number() over (partition by battery_id order by seq) - 1 as point,
  seq, y - yhat as residual from scores""", views=S, doubles=["residual"])
def q_residual_series(spark, sf_dir):
    """Residuals of each battery in the order of its readings."""
    s = pr.trend_series(ev.residuals(scores(spark, sf_dir)), ["residual"], by=("battery_id",))
    return s.select("battery_id", "point", F.col("seq_from").alias("seq"), "residual")


CONF_CTE = f""", cf as (
  select count_if(prob >= {TH}e0 and label = 1) as tp, count_if(prob >= {TH}e0 and label <> 1) as fp,
    count_if(prob < {TH}e0 and label = 1) as fn, count_if(prob < {TH}e0 and label <> 1) as tn from scores)"""


@register("confusion", CONF_CTE + "\nselect * from cf", views=S)
def q_confusion(spark, sf_dir):
    return ev.confusion(scores(spark, sf_dir), threshold=TH)


@register("cls_metrics", CONF_CTE + """
, m as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall,
  coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) as accuracy from cf)
select tp, fp, fn, tn, precision, recall,
  coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1, accuracy from m""",
          views=S, doubles=["precision", "recall", "f1", "accuracy"])
def q_cls_metrics(spark, sf_dir):
    return ev.cls_metrics(ev.confusion(scores(spark, sf_dir), threshold=TH))


@register("cls_report", CONF_CTE + """
, m as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p1, coalesce(tp / nullif(tp + fn, 0), 0) as r1,
    coalesce(tn / nullif(tn + fn, 0), 0) as p0, coalesce(tn / nullif(tn + fp, 0), 0) as r0,
    cast(tp + fn as double) as s1, cast(tn + fp as double) as s0 from cf)
, f as (select *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) as f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) as f0,
    s0 + s1 as n from m)
select '0' as class, p0 as precision, r0 as recall, f0 as f1, cast(s0 as bigint) as support from f
union all select '1', p1, r1, f1, cast(s1 as bigint) from f
union all select 'accuracy', null, null, coalesce((tp + tn) / nullif(n, 0), 0), cast(n as bigint) from f
union all select 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, cast(n as bigint) from f
union all select 'weighted avg', coalesce((p0 * s0 + p1 * s1) / nullif(n, 0), 0), coalesce((r0 * s0 + r1 * s1) / nullif(n, 0), 0),
  coalesce((f0 * s0 + f1 * s1) / nullif(n, 0), 0), cast(n as bigint) from f""",
          views=S, doubles=["precision", "recall", "f1"])
def q_cls_report(spark, sf_dir):
    return ev.cls_report(ev.confusion(scores(spark, sf_dir), threshold=TH))


CURVE_CTE = """, c as (select prob, count_if(label = 1) as pos, count_if(label <> 1) as neg from scores
  where prob is not null group by prob)
, r as (select prob, pos, neg,
    sum(pos) over (order by prob desc rows between unbounded preceding and current row) as cum_pos,
    sum(neg) over (order by prob desc rows between unbounded preceding and current row) as cum_neg,
    sum(pos) over () as tot_pos, sum(neg) over () as tot_neg from c)
, pr as (select prob as threshold, cum_pos / (cum_pos + cum_neg) as precision, cum_pos / tot_pos as recall from r)"""


@register("roc_points", CURVE_CTE + """
select prob as threshold, cast(cum_pos as bigint) as tp, cast(cum_neg as bigint) as fp,
  cum_pos / tot_pos as tpr, cum_neg / tot_neg as fpr from r""", views=S, doubles=["threshold", "tpr", "fpr"])
def q_roc_points(spark, sf_dir):
    return ev.roc_points(scores(spark, sf_dir))


@register("roc_auc", CURVE_CTE + """
select cast(max(tot_pos) as bigint) as n_pos, cast(max(tot_neg) as bigint) as n_neg,
  case when max(tot_pos) > 0 and max(tot_neg) > 0 then sum(neg * (cum_pos - pos / 2)) / (max(tot_pos) * max(tot_neg)) end
    as roc_auc,
  case when max(tot_pos) = 0 or max(tot_neg) = 0 then 'single class: ROC AUC undefined, precision uninformative' end
    as reason
from r""", views=S, doubles=["roc_auc"])
def q_roc_auc(spark, sf_dir):
    return ev.roc_auc(scores(spark, sf_dir))


@register("pr_curve", CURVE_CTE + "\nselect * from pr", views=S, doubles=["threshold", "precision", "recall"])
def q_pr_curve(spark, sf_dir):
    return ev.pr_curve(scores(spark, sf_dir))


@register("pr_nearest", CURVE_CTE + f"""
select threshold, precision, recall from pr order by abs(threshold - {TH}e0), threshold limit 1""",
          views=S, doubles=["threshold", "precision", "recall"])
def q_pr_nearest(spark, sf_dir):
    return ev.pr_nearest(ev.pr_curve(scores(spark, sf_dir)), TH)


@register("threshold_pr", CURVE_CTE + "\nselect max(threshold) as threshold from pr where recall >= 0.85e0",
          views=S, doubles=["threshold"])
def q_threshold_pr(spark, sf_dir):
    return ev.threshold_pr(ev.pr_curve(scores(spark, sf_dir)))


SWEEP_SQL = """, g as (select cast(i as integer) as i, 0.2e0 + i * 0.05e0 as threshold from range(0, 10) t(i))
, m0 as (select g.i, g.threshold, count_if(prob >= threshold and label = 1) as tp,
    count_if(prob >= threshold and label <> 1) as fp, count_if(prob < threshold and label = 1) as fn
  from g cross join scores group by g.i, g.threshold)
, m1 as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall from m0)
, m2 as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1,
    recall >= 0.85e0 as meets_recall, precision >= 0.6e0 as meets_precision from m1)
, m3 as (select *, row_number() over (order by meets_recall desc, round(f1, 12) desc, i) as rk from m2)
, b as (select coalesce(max(case when rk = 1 and meets_recall then threshold end), 0.5e0) as chosen_threshold from m3)
select threshold, tp, fp, fn, precision, recall, f1, meets_recall, meets_precision, chosen_threshold,
  threshold = chosen_threshold as is_best from m3 cross join b"""


@register("threshold_sweep", SWEEP_SQL, views=S,
          doubles=["threshold", "precision", "recall", "f1", "chosen_threshold"])
def q_threshold_sweep(spark, sf_dir):
    return ev.threshold_sweep(scores(spark, sf_dir))


@register("missed_events", f"select battery_id, seq, prob from scores where label = 1 and prob < {TH}e0",
          views=S, doubles=["prob"])
def q_missed_events(spark, sf_dir):
    return ev.missed_events(scores(spark, sf_dir), threshold=TH).select(*KEYS, "prob")


GUARD_SQL = SPLIT_CTE + """
, s as (select battery_id, over_temp_flag as label, (seq * 37 % 1000) * 0.0007e0 + over_temp_flag * 0.3e0 as prob
  from sp where split = 'test')
, c as (select battery_id, prob, count_if(label = 1) as pos, count_if(label <> 1) as neg from s group by battery_id, prob)
, r as (select *, sum(pos) over (partition by battery_id order by prob desc rows between unbounded preceding and current row) as cum_pos,
    sum(pos) over (partition by battery_id) as tot_pos, sum(neg) over (partition by battery_id) as tot_neg from c)
select battery_id, cast(max(tot_pos) as bigint) as n_pos, cast(max(tot_neg) as bigint) as n_neg,
  case when max(tot_pos) > 0 and max(tot_neg) > 0 then sum(neg * (cum_pos - pos / 2)) / (max(tot_pos) * max(tot_neg)) end
    as roc_auc,
  case when max(tot_pos) = 0 or max(tot_neg) = 0 then 'single class: ROC AUC undefined, precision uninformative' end
    as reason
from r group by battery_id"""


@register("single_class_guard", GUARD_SQL, doubles=["roc_auc"])
def q_single_class_guard(spark, sf_dir):
    s = sp.chrono_split(telemetry(spark, sf_dir)).where(F.col("split") == "test")
    s = s.select("battery_id", F.col("over_temp_flag").alias("label"),
                 (((F.col("seq") * 37) % 1000) * F.lit(0.0007) + F.col("over_temp_flag") * F.lit(0.3)).alias("prob"))
    return ev.roc_auc(s, by=["battery_id"])


# Candidate regressors derived from the data: the scores view's yhat, the battery's train
# mean IR and the fleet's train mean IR; metrics on each battery's test split.
CAND_SQL = SPLIT_CTE + """
, bm as (select battery_id, avg(internal_resistance) as bmean from sp where split = 'train' group by battery_id)
, fm as (select avg(internal_resistance) as fmean from sp where split = 'train')
, t as (select sp.*, internal_resistance + (seq % 21 - 10) * 0.0001e0 as yhat_scores, bmean, fmean
  from sp join bm using (battery_id) cross join fm where split = 'test')
, l as (select 'scores' as model, internal_resistance as y, yhat_scores as yhat from t
  union all select 'battery_mean', internal_resistance, bmean from t
  union all select 'fleet_mean', internal_resistance, fmean from t)
, mt as (select model, avg(abs(y - yhat)) as mae, sqrt(avg((y - yhat) * (y - yhat))) as rmse,
  1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(y)) as r2, max(abs(y - yhat)) as max_error, count(*) as n
  from l group by model)"""


# Candidate regressors and their columns, in the listed order.
REG_CANDS = {"scores": "yhat_scores", "battery_mean": "bmean", "fleet_mean": "fmean"}


def candidates(spark, sf_dir):
    s = sp.chrono_split(telemetry(spark, sf_dir))
    tr = s.where(F.col("split") == "train")
    bm = tr.groupBy("battery_id").agg(F.avg("internal_resistance").alias("bmean"))
    fm = tr.agg(F.avg("internal_resistance").alias("fmean"))
    t = attach_row(s.where(F.col("split") == "test").join(bm, "battery_id"), fm, "_fm") \
        .withColumn("fmean", F.col("_fm.fmean")).drop("_fm")
    t = t.withColumn("yhat_scores", F.col("internal_resistance") + ((F.col("seq") % 21) - 10) * F.lit(0.0001))
    y = F.col("internal_resistance").alias("y")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("yhat")) for m, c in REG_CANDS.items()])).alias("m")
    long = t.select(y, each).select("m.model", "y", "m.yhat")  # one scan for all candidates
    return ev.reg_metrics(long, by=["model"]).withColumn("order", F.array_position(F.array(*[F.lit(m) for m in REG_CANDS]), F.col("model")).cast("int"))


@register("metrics_table", CAND_SQL + """
select mt.*, case when r2 >= 0.8e0 then 'good' when r2 >= 0.6e0 then 'moderate' else 'weak' end as r2_band,
  r2 < 0.5e0 as needs_nonlinear from mt""", doubles=["mae", "rmse", "r2", "max_error"])
def q_metrics_table(spark, sf_dir):
    return ev.metrics_table(candidates(spark, sf_dir)).drop("order")


@register("select_regressor", CAND_SQL + "\nselect arg_min(model, (rmse, case model when 'scores' then 1 when 'battery_mean' then 2 else 3 end)) as selected from mt")
def q_select_regressor(spark, sf_dir):
    return ev.select_regressor(candidates(spark, sf_dir))


# Candidate classifiers: the scores at three thresholds (listed order = tie order).
CLS_CANDS = [("prob_at_0.20", 0.2), ("prob_at_0.35", 0.35), ("prob_at_0.50", 0.5)]


def cls_candidates(spark, sf_dir):
    # one scan: each score meets the three thresholds, as 1 or 0
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(i).alias("order"), (F.col("prob") >= th).cast("int").alias("hit"))
                               for i, (n, th) in enumerate(CLS_CANDS)])).alias("m")
    long = scores(spark, sf_dir).select("label", each).select("label", "m.*")
    conf = ev.confusion(long, prob="hit", threshold=1, by=["model", "order"])
    return ev.cls_metrics(conf).select("model", "order", "precision", "recall", "f1")


CLS_CAND_SQL = ", cc as (" + "\nunion all\n".join(
    f"""select '{n}' as model, {i} as ord, count_if(prob >= {t}e0 and label = 1) as tp,
  count_if(prob >= {t}e0 and label <> 1) as fp, count_if(prob < {t}e0 and label = 1) as fn from scores"""
    for i, (n, t) in enumerate(CLS_CANDS)) + """)
, cm as (select model, ord, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall
  from cc)
, cf as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from cm)"""


@register("select_classifier", CLS_CAND_SQL + """
select coalesce((select model from cf where recall >= 0.85e0 order by round(f1, 12) desc, ord limit 1),
                (select model from cf order by round(f1, 12) desc, ord limit 1)) as selected""", views=S)
def q_select_classifier(spark, sf_dir):
    return ev.select_classifier(cls_candidates(spark, sf_dir))
