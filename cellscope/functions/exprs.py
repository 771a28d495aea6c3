"""Pure column expressions (JVM side, whole-stage codegen). No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule and score constants of the reference.
OVER_VOLTAGE_ACTION_V = 4.15
OVER_VOLTAGE_TERMINAL_V = 4.18
HEALTH_WEIGHTS = {"ir": 0.4, "thermal": 0.35, "voltage": 0.25}
FLAG_OK_SCORE = 100.0
FLAG_BAD_SCORE = 40.0
STATUS_BANDS = [(80.0, "HEALTHY"), (60.0, "DEGRADING"), (40.0, "CRITICAL")]
STATUS_FLOOR = "END_OF_LIFE"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is 0 or NULL (pandas would give inf/NaN; ANSI Spark would raise)."""
    return F.try_divide(col(a), col(b))


def over_voltage(action_v: str | Column = "action_voltage",
                 terminal_v: str | Column = "terminal_voltage") -> Column:
    """``action_voltage > 4.15 OR terminal_voltage > 4.18`` as 0/1; NULL counts as 0."""
    rule = (col(action_v) > F.lit(OVER_VOLTAGE_ACTION_V)) | (col(terminal_v) > F.lit(OVER_VOLTAGE_TERMINAL_V))
    return F.coalesce(rule, F.lit(False)).cast("int")


def over_voltage_of(df: DataFrame) -> Column:
    """``over_voltage`` over the columns of ``df``; an absent one counts as 0."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    return over_voltage(have("action_voltage"), have("terminal_voltage"))


def temp_flag(prob: str | Column, threshold: float = 0.5) -> Column:
    """``prob >= threshold`` as 0/1."""
    return F.coalesce(col(prob) >= F.lit(float(threshold)), F.lit(False)).cast("int")


def soc_bin(x: str | Column, lo: str | Column, hi: str | Column, k: int) -> Column:
    """``pd.cut(x, bins=k, labels=False)``: k equal-width right-closed bins over [lo, hi],
    the minimum falls in bin 0. A constant column lies in the middle of a widened range, as in
    pandas: bin 9 of 20, bin 4 of 10."""
    width = F.try_divide(col(hi) - col(lo), F.lit(float(k)))
    raw = F.ceil(F.try_divide(col(x) - col(lo), F.nullif(width, F.lit(0.0)))) - 1
    # greatest() skips NULLs, so keep the NULL of a zero-width range explicitly
    return F.when(raw.isNotNull(), F.greatest(F.lit(0), raw.cast("int"))) \
        .when(col(x).isNotNull() & (col(lo) == col(hi)), F.lit((k + 1) // 2 - 1))


def adjusted_skew(skew_pop: str | Column, n: str | Column) -> Column:
    """Bias-corrected sample skewness G1 = g1 * sqrt(n(n-1)) / (n-2) (pandas ``skew``)."""
    n = col(n).cast("double")
    return col(skew_pop) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))


def ir_health(ir: str | Column, ir_min: str | Column, ir_max: str | Column) -> Column:
    """max(0, 100 - min-max position * 100). No upper cap: IR below the fleet minimum scores > 100."""
    pos = F.try_divide(col(ir) - col(ir_min), col(ir_max) - col(ir_min)) * 100
    return F.greatest(F.lit(0.0), F.lit(100.0) - pos)


def flag_health(flag: str | Column) -> Column:
    """100 only where the flag is 0; a NULL flag does not count as safe."""
    return F.when(col(flag) == 0, F.lit(FLAG_OK_SCORE)).otherwise(F.lit(FLAG_BAD_SCORE))


def weighted_health(ir_h: Column, thermal_h: Column, voltage_h: Column) -> Column:
    w = HEALTH_WEIGHTS
    total = w["ir"] + w["thermal"] + w["voltage"]
    return (ir_h * w["ir"] + thermal_h * w["thermal"] + voltage_h * w["voltage"]) / F.lit(total)


def health_status(score: str | Column) -> Column:
    s = col(score)
    expr = None
    for bound, label in STATUS_BANDS:
        expr = F.when(s >= bound, label) if expr is None else expr.when(s >= bound, label)
    return expr.otherwise(STATUS_FLOOR)
