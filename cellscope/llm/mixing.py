"""Mixing sources to target weights by Pareto order sampling.

Sources, by code point with NULL last, weigh 1, 2, 3, repeating, and share all words of the
corpus; a source's target stops at ``MAX_COPIES`` times its size, and the excess is shared anew
by weight among the others until none is above. A source whose target is r times its size takes
floor(r) certain copies of each document. The rest of the target is a sample without
replacement: documents are ranked by the odds of a random number over the odds of their
inclusion, which are unequal (proportional to the square root of a document's size), and are
taken in this order; a document larger than the words still missing is skipped. When these are
fewer than ``FEW`` mean documents of those that still fit, the largest that fits is taken each
time. Both go on until none fits. Only whole documents are taken.

The random number is a digest of the id, source and text, and of the number among rows alike in
these, so reruns agree. Ranking never gathers a source: ranks fall into ``BUCKETS`` buckets a
source, their sums show where the first document that does not fit stands, and only that bucket
is sorted. This is repeated over the documents after it that fit, until none is left.

Edge cases: a NULL or empty text has size 0 and takes 0; rows alike in id, source and text are
sampled one by one; a NULL source is a source of its own; an empty table gives an
empty result; other columns are not read by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscope.llm.common import checkpointed, table, word_array

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
BUCKETS = 4096
FEW = 4        # mean documents left to take from which on the largest that fits is taken
SALTS = 64     # parts that a source is dealt to in joins


def ranked_sources(units: DataFrame) -> DataFrame:
    """(source, source_size, weight): one row a source. Sources are numbered in the order of a
    range partitioning, so that no task holds them all."""
    per = checkpointed(units.groupBy("source").agg(F.sum("size").alias("source_size")))
    ordered = per.orderBy(F.col("source").asc_nulls_last())
    numbered = ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], WEIGHTS[x[1] % len(WEIGHTS)]))
    return checkpointed(units.sparkSession.createDataFrame(numbered, "source string, source_size bigint, weight int"))


def targets(sources: DataFrame) -> DataFrame:
    """Adds target (double). Each round caps the sources above their limit and shares the rest;
    a round's state is three numbers."""
    cap = F.col("source_size") * MAX_COPIES
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    share = None  # words a unit of weight; it only grows
    while True:
        over = F.lit(False) if share is None else F.col("weight") * F.lit(share) > cap
        held, weight = sources.agg(F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        new = (words - (held or 0)) / weight if weight else share
        if new == share or not weight:
            break
        share = new
    share = 0.0 if share is None else float(share)
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(share), cap.cast("double")))


def alike(id_col: Column, source: Column, text: Column) -> Column:
    """A digest that rows share if they are alike in id, source and text. Bars inside of id and
    source are escaped, so text cannot shift from one part to the next."""
    escaped = lambda c: F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    part = lambda c: F.coalesce(F.concat(F.lit("="), escaped(c)), F.lit(""))
    return F.md5(F.concat_ws("|", part(id_col), part(source), F.coalesce(text, F.lit(""))))


def units_of(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(key, kind, id, source, size): the words of each row. Rows that are alike share ``kind`` and
    differ in ``key``, a digest of it with their number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(alike(F.col(id_col), F.col(source_col), text).alias("kind"), F.col(id_col).alias("id"),
                     F.col(source_col).alias("source"), F.size(word_array(text)).cast("long").alias("size"))
    kinds = rows.groupBy("kind").agg(F.first("id").alias("id"), F.first("source").alias("source"),
                                     F.first("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    each = kinds.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    key = F.when(F.col("nth") == 1, F.col("kind")).otherwise(F.md5(F.concat_ws("#", "kind", F.col("nth").cast("string"))))
    return each.select(key.alias("key"), "kind", "id", "source", "size")


def rank_of(key: Column, size: Column, rest: Column, source_size: Column) -> Column:
    """Odds of a random number over odds of inclusion, as a number in (0, 1) of the same order.
    The odds of inclusion are the source's sampling odds times the square root of the size."""
    u = (F.conv(F.substring(key, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    rate = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), rest / source_size))
    odds = (u / (1 - u)) / (F.sqrt(size.cast("double")) * (rate / (1 - rate)))
    return odds / (1 + odds)


def by_source(rows: DataFrame, one_each: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows (s, key, ...) with a table that has one row a source, dealing each source to
    SALTS parts, so that a frequent one does not meet in one task."""
    names = [c for c in one_each.columns if c != "s"]
    right = one_each.select(F.col("s").alias("_s"), *names, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    x = rows.withColumn("_salt", salt)
    return x.join(right, F.col("s").eqNullSafe(F.col("_s")) & (F.col("_salt") == F.col("_part")), how).drop("_s", "_part", "_salt")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per kind of alike rows and number of copies: key, id, source, size, rows, source_size,
    target, copies (how often the mix takes each of these ``rows`` rows)."""
    units = checkpointed(units_of(df, id_col, text_col, source_col))
    sources = checkpointed(targets(ranked_sources(units)))
    s = sources.select(F.col("source").alias("s"), "source_size", "target",
                       F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long").alias("certain")) \
        .withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    x = by_source(units.withColumn("s", F.col("source")), s)
    # documents without words have no odds; they take nothing
    rank = rank_of(F.col("key"), F.col("size"), F.col("rest"), F.col("source_size"))
    x = x.withColumn("rank", F.when(F.col("size") > 0, rank)) \
        .withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor(F.col("rank") * BUCKETS)).cast("int"))
    y = checkpointed(x)
    place = F.struct("rank", "key")
    # what a source takes are stretches of its ranking: units of at most ``gap`` words that rank
    # after ``lo`` and before ``hi``, the first unit that did not fit; near the end, single picks
    state = s.select("s", F.col("rest").alias("gap"), F.lit(None).cast("struct<rank:double,key:string>").alias("lo"),
                     F.array().cast("array<string>").alias("picks"))
    stretches = None

    def open_units(of: DataFrame) -> DataFrame:
        return by_source(y.select("s", "key", "size", "rank", "bucket"), of.select("s", "gap", "lo", "picks")) \
            .where((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & (F.col("lo").isNull() | (place > F.col("lo")))
                   & ~F.array_contains("picks", F.col("key")))
    while True:
        if stretches is None:
            step = state.withColumn("pick", F.lit(None).cast("struct<size:bigint,key:string>"))
        else:
            fits = open_units(state).groupBy(F.col("s").alias("_f")).agg(
                F.avg("size").alias("mean"), F.max(F.struct("size", "key")).alias("top"))
            step = checkpointed(state.join(fits, F.col("s").eqNullSafe(F.col("_f"))).select(
                "s", "gap", "lo", "picks", F.when(F.col("gap") < FEW * F.col("mean"), F.col("top")).alias("pick")))
            if step.isEmpty():  # nothing fits in any source
                break
        left = open_units(step.where("pick is null"))
        sums = left.groupBy("s", "gap", "bucket").agg(F.sum("size").alias("in_bucket"))
        before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        ends = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0).cast("long"))) \
            .where((F.col("before") <= F.col("gap")) & (F.col("before") + F.col("in_bucket") > F.col("gap"))) \
            .select("s", F.col("bucket").alias("end_bucket"), "before")
        # only the bucket in which a source's stretch ends is sorted
        upto = Window.partitionBy("s").orderBy("rank", "key").rowsBetween(Window.unboundedPreceding, 0)
        edge = by_source(left, ends).where(F.col("bucket") == F.col("end_bucket")) \
            .withColumn("upto", F.col("before") + F.sum("size").over(upto)) \
            .groupBy(F.col("s").alias("_e")).agg(
                F.coalesce(F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))), F.first("before")).alias("reached"),
                F.min(F.when(F.col("upto") > F.col("gap"), place)).alias("hi"))
        if step.where("pick is null").isEmpty():
            step = step.withColumn("reached", F.lit(None).cast("long")).withColumn("hi", F.col("lo"))
        else:
            step = checkpointed(step.join(edge, F.col("s").eqNullSafe(F.col("_e")), "left").drop("_e"))
        stretches = step if stretches is None else stretches.unionByName(step)
        # a source in which all that is left fits is done
        state = step.where("pick is not null or hi is not null").select(
            "s", (F.col("gap") - F.coalesce("pick.size", "reached")).alias("gap"),
            F.when(F.col("pick").isNull(), F.col("hi")).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("pick").isNull(), F.col("picks")).otherwise(F.array_append("picks", F.col("pick.key"))).alias("picks"))
    per = stretches.groupBy("s").agg(F.collect_list(F.struct("gap", "lo", "hi", "pick.key")).alias("stretches"))
    z = by_source(y, checkpointed(per))
    within = lambda t: ((F.col("size") <= t["gap"]) & (t["lo"].isNull() | (place > t["lo"]))
                        & (t["hi"].isNull() | (place < t["hi"])))
    sampled = (F.col("size") > 0) & F.exists("stretches", lambda t: F.when(t["key"].isNull(), within(t)).otherwise(t["key"] == F.col("key")))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.least(F.lit(MAX_COPIES), F.col("certain") + sampled.cast("int"))).cast("long")
    z = z.withColumn("copies", copies)
    return z.groupBy("kind", "copies").agg(*[F.first(c).alias(c) for c in ("id", "source", "size", "source_size", "target")],
                                           F.count(F.lit(1)).alias("rows")) \
        .select(F.col("kind").alias("key"), "id", "source", "size", "rows", "source_size", "target", "copies")


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row as many times as the mix takes it, with its columns as they are.
    If the mix takes some of the rows that are alike once more than the others, those are the
    first by a hash of all columns."""
    each = mix(df, id_col, text_col, source_col).groupBy(F.col("key").alias("_k")).agg(
        F.min("copies").alias("_copies"), F.max("copies").alias("_most"), F.max_by("rows", "copies").alias("_rows"))
    took = checkpointed(each.where("_most > 0").select("_k", "_copies", F.when(F.col("_most") > F.col("_copies"), F.col("_rows"))
                                                       .otherwise(F.lit(0)).alias("_more")))
    names = [f"c{i}" for i in range(len(df.columns))]
    x = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)],
                  alike(F.col(id_col), F.col(source_col), F.col(text_col)).alias("_key"))
    uneven = took.where("_more > 0")
    if uneven.isEmpty():
        x = x.join(took, F.col("_key") == F.col("_k"))
    else:
        first = Window.partitionBy("_key").orderBy("_hash")
        part = x.join(uneven, F.col("_key") == F.col("_k")).withColumn("_hash", F.xxhash64(*names)) \
            .withColumn("_copies", F.col("_copies") + (F.row_number().over(first) <= F.col("_more")).cast("int")).drop("_hash")
        x = x.join(took.where("_more = 0"), F.col("_key") == F.col("_k")).unionByName(part)
    x = x.where("_copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return x.select(*[F.col(n).alias(c) for c, n in zip(df.columns, names, strict=True)])


def op7(spark, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    each = got.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"),
                       (F.col("copies") * F.col("size")).alias("taken"))
