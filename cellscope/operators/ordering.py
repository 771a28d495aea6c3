"""Exact order-dependent primitives that never put a whole group in one task.

A ``Window.partitionBy(g).orderBy(k)`` puts every row of a group in one task, and
without ``partitionBy`` Spark plans ``Exchange SinglePartition``. Both break when
one battery (or the whole table, read as one sequence) holds a third of the rows.

``running_totals`` orders groups of up to ``GROUP_ROWS`` rows by such a window. Where a group is
larger, which one count over the group columns tells, or without ``by``, it instead:

1. takes ``K`` approximate quantile bounds of the order key over the whole input
   (one driver-side pass, embedded as a literal array so every evaluation agrees) and
   buckets every row by binary search over them (JVM side); every bucket then holds
   about ``n/K`` rows whatever the group sizes are;
2. sums the weights per ``(group, bucket)`` (partial aggregation) and turns those
   sums into per-bucket offsets with a window over that small table;
3. adds each row's running sum inside its ``(group, bucket)`` partition.

The result is exact. ``rolling_frame`` builds trailing row frames on top of it by
cutting each group into fixed-size chunks and copying the last ``w-1`` rows of a
chunk into the next one (a halo), so a frame never needs more than one chunk.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_CHUNK_ROWS = 1_000_000
FILE_ROWS = 50_000  # rows of a file of a written frame
GROUP_ROWS = 1_000_000  # rows of a group that one task may order; larger groups are bucketed


def default_buckets(df: DataFrame) -> int:
    """Bucket count: a power of two near twice the shuffle partitions (capped)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    k = max(4, min(2 * n, 65_536))
    return 1 << (k - 1).bit_length()


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group: one count that reads the group columns only."""
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def quantile_bounds(df: DataFrame, col: str, n_buckets: int) -> list[float]:
    """K-1 approximate quantile bounds of ``col`` (sorted, unique), as a driver-side list
    (one pass over ``df``; at most K-1 numbers)."""
    if n_buckets <= 1:
        return []
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = df.where(F.col(col).isNotNull()).approxQuantile(col, probs, 1.0 / (4 * n_buckets))
    return sorted({float(b) for b in bounds})


def attach_row(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach a one-row table (fitted parameters, fleet statistics, bounds) to every row as a
    struct column through a scalar subquery: computed once, no join, and Spark fails the
    query if the table ever holds more than one row (the size bound is enforced)."""
    return df.withColumn(name, one_row.select(F.struct(*one_row.columns).alias(name)).scalar())


def with_bucket(df: DataFrame, col: str, n_buckets: int, out: str = "_bk") -> DataFrame:
    """Bucket id in [0, K-1] = number of approximate K-quantile bounds <= ``col``.

    The bounds are computed once on the driver (one ``approxQuantile`` pass, at most K-1
    numbers) and embedded as a literal array, so every evaluation of the plan, including
    recomputed tasks after an executor loss and both branches of ``running_totals``, assigns
    the same bucket to a row. The bucket is found by an unrolled binary search over the array
    (log2 K levels of ``element_at``, JVM side)."""
    k = 1 << max(0, (n_buckets - 1).bit_length())  # power of two
    bounds = quantile_bounds(df, col, k)
    if not bounds:
        return df.withColumn(out, F.lit(0))
    m = len(bounds)
    # one JSON string, constant-folded into a literal array by the optimizer (fast for 65k bounds)
    arr = F.from_json(F.lit(json.dumps([float(b) for b in bounds])), "array<double>")
    x = df.withColumn("_bq", arr).withColumn(out, F.lit(0))
    v = F.col(col).cast("double")
    step = 1 << (m.bit_length() - 1) if m > 0 else 0
    while step >= 1:
        cand = F.col(out) + step  # 1-based index into the bounds
        hit = (cand <= m) & (F.try_element_at(F.col("_bq"), cand) <= v)
        x = x.withColumn(out, F.when(hit, cand).otherwise(F.col(out)))
        step //= 2
    return x.drop("_bq")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet; the keys of ``right`` are dropped. Without keys the
    right side must have one row, which is attached."""
    names = {k: f"_r_{k}" for k in keys}
    r = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(names[k]))
        on = c if on is None else on & c
    return left.join(r, on, how).drop(*names.values())


def running_totals(df: DataFrame, order_col: str, by: Sequence[str] = (),
                   weights: dict[str, Column | str] | None = None, descending: bool = False,
                   n_buckets: int | None = None, prefix: str = "cum_",
                   total_prefix: str = "tot_", tiebreak: Sequence[str] = (), largest: int | None = None) -> DataFrame:
    """Inclusive running sum of each weight along ``order_col`` inside each ``by`` group,
    plus the group total: adds ``cum_<w>`` and ``tot_<w>``.

    ``order_col`` must be unique within a group (rows are pre-aggregated by value where
    it is not) and non-null; ``tiebreak`` columns order rows with equal keys. A caller that
    knows a bound on the rows of a group passes it as ``largest`` and saves the count.
    """
    by = list(by)
    weights = weights or {"rows": F.lit(1)}
    wcols = {name: (F.col(w) if isinstance(w, str) else w) for name, w in weights.items()}
    oc = F.col(order_col).desc() if descending else F.col(order_col).asc()
    if by and n_buckets is None and (largest_group(df, by) if largest is None else largest) <= GROUP_ROWS:
        # no group is too large for one task: one shuffle, no bounds, no join
        inside = Window.partitionBy(*by).orderBy(oc, *tiebreak).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*by)
        return df.select(
            "*", *[F.sum(c.cast("double")).over(inside).alias(f"{prefix}{n}") for n, c in wcols.items()],
            *[F.sum(c.cast("double")).over(whole).alias(f"{total_prefix}{n}") for n, c in wcols.items()])
    k = n_buckets or default_buckets(df)
    base = df.select("*", *[c.cast("double").alias(f"_w_{n}") for n, c in wcols.items()])
    base = with_bucket(base, order_col, k)
    if descending:
        base = base.withColumn("_bk", -F.col("_bk"))
    # per (group, bucket) sums (partial aggregation) -> offsets (small table: <= K rows per group)
    sums = base.groupBy(*by, "_bk").agg(*[F.sum(f"_w_{n}").alias(f"_s_{n}") for n in wcols])
    before = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offs = sums.select(
        *by, "_bk",
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0.0)).alias(f"_o_{n}") for n in wcols],
        *[F.sum(f"_s_{n}").over(whole).alias(f"{total_prefix}{n}") for n in wcols],
    )
    joined = join_null_safe(base, offs, [*by, "_bk"])
    inside = Window.partitionBy(*by, "_bk").orderBy(oc, *tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.sum(f"_w_{n}").over(inside)).alias(f"{prefix}{n}") for n in wcols],
        *[F.col(f"{total_prefix}{n}") for n in wcols],
    )
    return out


def with_position(df: DataFrame, order_col: str = "seq", by: Sequence[str] = ("battery_id",),
                  pos_col: str = "pos", count_col: str = "n_rows",
                  n_buckets: int | None = None, tiebreak: Sequence[str] = (), largest: int | None = None) -> DataFrame:
    """Exact 0-based position of each row in its group (ordered by ``order_col``) and the
    group size. Equivalent to ``row_number() - 1`` and ``count(*)`` over the group. ``largest`` as in
    ``running_totals``."""
    r = running_totals(df, order_col, by, {"rows": F.lit(1)}, n_buckets=n_buckets, tiebreak=tiebreak, largest=largest)
    return r.withColumn(pos_col, (F.col("cum_rows") - 1).cast("long")) \
        .withColumn(count_col, F.col("tot_rows").cast("long")).drop("cum_rows", "tot_rows")


def rolling_frame(df: DataFrame, aggs: dict[str, callable], window: int, pos_col: str,
                  by: Sequence[str] = (), chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Trailing frame of ``window`` rows (``rowsBetween(-(window-1), 0)``) by exact position.

    ``aggs`` maps an output name to ``f(frame_window) -> Column``. Each group is cut into
    chunks of ``chunk_rows`` positions; the last ``window-1`` rows of a chunk are copied into
    the next chunk as a halo and dropped after the frame is computed.
    """
    if chunk_rows < window:
        raise ValueError("chunk_rows must be >= window")
    by = list(by)
    p = F.col(pos_col)
    halo = window - 1
    shifted = df.select(
        "*",
        F.explode(F.when((p % chunk_rows) >= chunk_rows - halo, F.array(F.lit(0), F.lit(1)))
                  .otherwise(F.array(F.lit(0)))).alias("_shift"),
    ).withColumn("_chunk", F.floor(p / chunk_rows) + F.col("_shift"))
    w = Window.partitionBy(*by, "_chunk").orderBy(pos_col).rowsBetween(-halo, 0)
    out = shifted.select("*", *[f(w).alias(name) for name, f in aggs.items()])
    return out.where(F.col("_shift") == 0).drop("_shift", "_chunk")


SKETCH_ACCURACY = 2_000  # a sketch is off by at most one part in this of a group's rows
WHOLE = (float("-inf"), float("nan"))  # the segment without ends; nothing is above NaN
BRACKET_GROUPS = 64  # groups whose sketches fit a task and whose brackets fit a small broadcast table


def _segments(bounds: Sequence[float], n: int) -> list[float]:
    """Disjoint closed segments, flat as low, high, low, high, ..., from sketched bounds in pairs. A
    group of so few rows that a sketch says nothing about them has one segment without ends."""
    if n <= SKETCH_ACCURACY:
        return list(WHOLE)
    out: list[float] = []
    for lo, hi in sorted(zip(bounds[::2], bounds[1::2])):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def _bracketed_counts(df: DataFrame, cols: Sequence[str], by: list[str], found: dict, slots: int) -> DataFrame:
    """(by..., feature, part, value, c): the rows of each group and column, counted by value inside
    of its segments and as one row a gap outside of them (``value`` is the least of the gap). Odd
    parts are segments. Partial aggregation leaves the segments' values and the gaps to shuffle."""
    padded = {g: [(list(s) + [None] * 2 * slots)[:2 * slots] for s in segs] for g, segs in found.items()}
    if by:
        schema = T.StructType([T.StructField(b, df.schema[b].dataType) for b in by] +
                              [T.StructField("_ends", T.ArrayType(T.ArrayType(T.DoubleType())))])
        # at most BRACKET_GROUPS rows
        x = join_null_safe(df, F.broadcast(df.sparkSession.createDataFrame([(*g, s) for g, s in padded.items()], schema)), by)
        ends = F.col("_ends")
    else:
        texts = [[f"double('{e}')" if e is not None else "cast(null as double)" for e in s] for s in padded[()]]
        x, ends = df, F.expr("array(" + ", ".join(f"array({', '.join(t)})" for t in texts) + ")")
    values = F.array(*[F.col(c).cast("double") for c in cols])
    long = x.select(*by, *(["_ends"] if by else []), F.posexplode(values).alias("i", "v")).where(F.col("v").isNotNull())
    # a NULL end is never met, so a missing segment holds nothing
    whens = "".join(f" when v {'<=' if j % 2 else '<'} own[{j}] then {j}" for j in range(2 * slots))
    long = long.select(*by, "i", "v", ends[F.col("i")].alias("own")).withColumn("part", F.expr(f"case{whens} else {2 * slots} end"))
    kept = F.when(F.col("part") % 2 == 1, F.col("v"))
    counts = long.groupBy(*by, "i", "part", kept.alias("kept")).agg(F.min("v").alias("value"), F.count(F.lit(1)).alias("c"))
    return counts.select(*by, F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1).alias("feature"), "part", "value", "c")


def _picked_quantiles(counts: DataFrame, probs: Sequence[float], by: list[str], n_buckets: int | None, largest: int | None) -> DataFrame:
    """The two order statistics around each target position, from counts by value, and their
    interpolation: (by..., feature, p, value, missed). ``missed`` tells that one of them lies in a gap."""
    cum = running_totals(counts, "value", [*by, "feature"], {"c": "c"}, n_buckets=n_buckets, largest=largest)
    # each distinct value covers positions [cum - c, cum - 1]; emit it for every target
    # position (floor / ceil of (n-1) p) it covers, then combine per (group, p)
    start, end = F.col("cum_c") - F.col("c"), F.col("cum_c") - 1
    hits = []
    for q in probs:
        h = (F.col("tot_c") - 1) * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)
        hit_lo = (lo >= start) & (lo <= end)
        hit_hi = (hi >= start) & (hi <= end)
        hits.append(F.when(hit_lo | hit_hi, F.struct(
            F.lit(float(q)).alias("p"), F.when(hit_lo, F.col("value")).alias("v_lo"),
            F.when(hit_hi, F.col("value")).alias("v_hi"), (h - lo).alias("frac"), (F.col("part") % 2 == 0).alias("gap"))))
    picked = cum.select(*by, "feature", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    g = picked.groupBy(*by, "feature", F.col("h.p").alias("p")).agg(
        F.max("h.v_lo").alias("v_lo"), F.max("h.v_hi").alias("v_hi"), F.max("h.frac").alias("frac"), F.bool_or("h.gap").alias("missed"))
    # equal neighbours are not interpolated, which keeps infinite values
    between = F.when(F.col("v_lo") == F.col("v_hi"), F.col("v_lo")).otherwise(F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac"))
    return g.select(*by, "feature", "p", between.alias("value"), "missed")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = (), n_buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas ``quantile`` / SQL ``percentile``) of
    every column in ``cols`` per ``by`` group, as a long table (by..., feature, p, value). A group
    without a value of a column has no row for it.

    One pass sketches all columns of all groups (mergeable summaries, at most some thousand
    numbers each); two ranks around each quantile bracket it. A second pass counts values by
    value inside the brackets, and only the rows outside them, so about 0.3 % of the values and
    quantile are shuffled. Positions in the kept values are exact, since the rows before them are
    counted. A quantile that its bracket has missed (a sketch worse than promised) shows as one in a
    gap, and the columns are then counted by value whole. More than ``BRACKET_GROUPS`` groups, whose
    brackets would be no small table, are always counted so. The result of bracketed groups is a
    local table of groups x columns x quantiles."""
    by, cols, probs = list(by), list(cols), [float(p) for p in probs]
    ranks = [min(1.0, max(0.0, p + d)) for p in probs for d in (-2.0 / SKETCH_ACCURACY, 2.0 / SKETCH_ACCURACY)]
    aggs = [a for i, c in enumerate(cols) for a in (
        F.percentile_approx(F.col(c).cast("double"), ranks, SKETCH_ACCURACY).alias(f"_q{i}"), F.count(c).alias(f"_n{i}"))]
    sketched = df.groupBy(*by).agg(*aggs).limit(BRACKET_GROUPS + 1).collect()
    plain = df.select(*[c for c in df.columns if c in {*by, *cols}])
    if len(sketched) > BRACKET_GROUPS:
        kv = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols]))
        long = plain.select(*by, kv.alias("kv")).select(*by, "kv.*").where(F.col("value").isNotNull())
        counts = long.groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("c")).withColumn("part", F.lit(1))
        return _picked_quantiles(counts, probs, by, n_buckets, None).drop("missed")
    found = {tuple(r[b] for b in by): [_segments(r[f"_q{i}"] or [], r[f"_n{i}"]) for i in range(len(cols))] for r in sketched}
    most = max((r[f"_n{i}"] for r in sketched for i in range(len(cols))), default=0)
    spark = df.sparkSession
    schema = T.StructType([T.StructField(b, df.schema[b].dataType) for b in by] + [
        T.StructField("feature", T.StringType()), T.StructField("p", T.DoubleType()), T.StructField("value", T.DoubleType())])
    if not found:  # no group, no row
        return spark.createDataFrame([], schema)
    # a bracket holds four parts by its ranks and at most two more by the sketch's error
    kept = min(most, max(SKETCH_ACCURACY, 6 * len(probs) * most // SKETCH_ACCURACY) + 2 * len(probs))
    for segs, largest in ((found, kept), ({g: [list(WHOLE)] * len(cols) for g in found}, most)):
        slots = max(len(s) for g in segs.values() for s in g) // 2
        counts = _bracketed_counts(plain, cols, by, segs, slots)
        if largest > GROUP_ROWS:
            counts, largest = checkpointed(counts), None  # bounds and sums read it again
        rows = _picked_quantiles(counts, probs, by, n_buckets, largest).collect()  # groups x columns x quantiles
        if not any(r["missed"] for r in rows):
            break
    # at most BRACKET_GROUPS groups: a join by them must not shuffle a group into one task
    return F.broadcast(spark.createDataFrame([tuple(r)[:-1] for r in rows], schema))


def materialize_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Replace a small result (fitted parameters, metric tables) by a local relation so later
    plans do not carry its lineage. Refuses anything over ``max_rows`` rows."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"materialize_small: more than {max_rows} rows")
    return df.sparkSession.createDataFrame(rows, schema=df.schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's checkpoint dir (a shared folder
    on a cluster); survives executor loss, unlike a local checkpoint."""
    from cellscope.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "frame") -> DataFrame:
    """Cut lineage as ``checkpointed`` does, for wide frames that are read many times: a table in the
    shared folder, of which a pass reads the columns it needs. Its files hold at most ``FILE_ROWS``
    rows, so the rows are dealt to all cores however they were written, and a task, to which Spark
    gives files of 128 MB with 4 MB added for each, gets at most 31 of them at any size."""
    from cellscope.session import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
