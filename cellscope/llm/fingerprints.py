"""Document fingerprints of closed syncmers, in DataFrame functions only.

A text is read as words. Every run of ``K`` words is looked at through its runs of ``S`` words:
it is a closed syncmer if the smallest hash among them lies at its first or last place. Whether a
run is chosen depends on its own words alone, so equal passages give equal anchors wherever they
stand and whatever surrounds them. A fingerprint holds all anchors, each with the place of its
first occurrence, so it grows with the text. As text it is every anchor by rising hash:
``hash@place``, comma-joined.

The likeness of two fingerprints is positional: among all anchors of both together, the share j
that both hold at a common shift (the middle one of all shared anchors, give or take ``SLACK``
words), told as 2j / (1 + j): about the share of the two texts that is common.

Edge cases: a text with fewer than K words has its whole sequence of words as one anchor; a NULL
or blank text has an empty fingerprint; equal fingerprints, empty ones included, have likeness 1.
Ids are whole numbers. Rows with equal ids follow each other by text, rows without an id come after
all others; the next document of the only row is itself; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscope.llm.common import let, table, word_array

K, S = 6, 2
SLACK = 2


def anchors_of(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Adds column ``out``: array of (h, at) by hash."""
    w, h, g, chosen, low = (f"_{out}_{x}" for x in ("w", "h", "g", "c", "l"))
    x = df.withColumn(w, word_array(text))
    x = x.withColumn(h, F.transform(w, lambda s: F.xxhash64(s)))
    hashes = F.col(h)
    inner = F.zip_with(hashes, F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0))),
                       lambda a, b: F.xxhash64(a, b))
    x = x.withColumn(g, inner)   # the last one lacks its second word and is never looked at
    ins, last = F.col(g), K - S
    edge = lambda i: F.least(F.get(ins, i), F.get(ins, i + last)) <= F.least(
        *[F.get(ins, i + j) for j in range(1, last)])
    # the hash of the run comes from the words at both edges and in its middle pairs
    run = lambda i: F.xxhash64(*[F.get(ins, i + j) for j in range(0, last + 1, S)])
    x = x.withColumn(chosen, F.when(F.size(hashes) >= K, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(hashes) - K, F.lit(0))), lambda i: F.when(edge(i), run(i))))
        .when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>")))
    # sorted by hash and place, the first of each hash stays
    runs = F.transform(F.col(chosen), lambda v, i: F.when(v.isNotNull(), F.struct(v.alias("h"), (i + 1).cast("bigint").alias("at"))))
    x = x.withColumn(low, F.sort_array(F.array_compact(runs)))
    x = x.withColumn(out, F.filter(low, lambda v, i: (i == 0) | (v["h"] != F.get(F.col(low), i - 1)["h"])))
    return x.drop(w, h, g, chosen, low)


def fingerprint_text(anchors: Column) -> Column:
    return F.array_join(F.transform(anchors, lambda a: F.concat(F.lower(F.hex(a["h"])), F.lit("@"), a["at"].cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Likeness in [0, 1] of two arrays of anchors."""
    side = lambda x, k: F.transform(x, lambda y: F.struct(y["h"].alias("h"), F.lit(k).alias("side"), y["at"].alias("at")))

    def shifts(both):
        # sorted by hash and side, a shared anchor of a is followed by that of b
        def shift(v, i):
            return let(F.get(both, i + 1), lambda n: F.when((v["side"] == 0) & (n["side"] == 1) & (n["h"] == v["h"]), n["at"] - v["at"]))
        return F.sort_array(F.array_compact(F.transform(both, shift)))

    def of(s):
        # the share j of the union that is common, as the share of both that is common
        mid = F.get(s, F.floor(F.size(s) / 2).cast("int"))
        j = let(mid, lambda m: F.size(F.filter(s, lambda x: F.abs(x - m) <= SLACK)) / (F.size(a) + F.size(b) - F.size(s)))
        return F.when(F.size(s) > 0, let(j, lambda j: 2 * j / (1 + j))).otherwise(F.lit(0.0))
    some = let(F.sort_array(F.concat(side(a, 0), side(b, 1))), lambda both: let(shifts(both), of))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(some)


PER_RANGE, MAX_RANGES = 512, 65536


def in_ranges(df: DataFrame, id_col: str, ranges: int) -> tuple[DataFrame, list]:
    """Adds ``_range``: which of about ``ranges`` equal shares of the ids a row lies in, by
    falling id, and the largest id of each range. Only the bounds come to the driver, at most
    ``MAX_RANGES`` numbers; a NULL id lies in the last range."""
    ids = df.select(F.col(id_col).alias("i")).where("i is not null")
    shares = [k / ranges for k in range(1, ranges)]
    bounds = [] if not shares else ids.agg(F.percentile_approx("i", shares, 20 * ranges).alias("b")).first()["b"]
    bounds = sorted(set(bounds or []), reverse=True)
    if not bounds:
        return df.withColumn("_range", F.when(F.col(id_col).isNull(), F.lit(1)).otherwise(F.lit(0))), bounds
    # ids above the first bound are range 0, those down to the second are range 1, and so on
    at, step = F.lit(0), 1 << (len(bounds).bit_length() - 1)
    x = df.withColumn("_bounds", F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")).withColumn("_range", at)
    while step:
        probe = F.col("_range") + step
        x = x.withColumn("_range", F.when((probe <= len(bounds)) & (F.try_element_at("_bounds", probe) >= F.col(id_col)), probe)
                         .otherwise(F.col("_range")))
        step //= 2
    return x.withColumn("_range", F.when(F.col(id_col).isNull(), F.lit(len(bounds) + 1)).otherwise(F.col("_range"))).drop("_bounds"), bounds


def with_next(df: DataFrame, id_col: str, payload: list[str], tie_col: str, rows: int) -> DataFrame:
    """Adds the ``payload`` columns of the next row by falling id as ``next_<column>``; the row
    after the last is the first. Ranges of ids are ordered by themselves; the first row of each
    range also goes to the end of the range before, so one shuffle is enough. Equal ids follow
    each other by a hash of ``tie_col``."""
    ranges = max(1, min(MAX_RANGES, rows // PER_RANGE))
    x, _ = in_ranges(df, id_col, ranges)
    x = x.withColumn("_tie", F.xxhash64(tie_col))
    order = F.struct(F.coalesce(F.col(id_col), F.lit(-2**63)).alias("i"), F.col(id_col).isNotNull().alias("k"), F.col("_tie").alias("t"))
    heads = sorted(_heads_of(x, order))
    if not heads:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in payload])
    before = {r: heads[k - 1][0] for k, (r, _) in enumerate(heads)}
    table_of = F.from_json(F.lit(json.dumps([{"r": r, "i": h[0], "k": h[1], "t": h[2], "p": before[r]} for r, h in heads])),
                           "array<struct<r:int,i:bigint,k:boolean,t:bigint,p:int>>")
    # a head is found by its range: ranges are numbered without gaps in this array
    place = {r: n for n, (r, _) in enumerate(heads)}
    gaps = F.from_json(F.lit(json.dumps([place.get(r, -1) for r in range(max(place) + 1)])), "array<int>")
    x = x.withColumn("_heads", table_of).withColumn("_gaps", gaps)
    x = x.withColumn("_head", F.get("_heads", F.get("_gaps", F.col("_range")))).drop("_heads", "_gaps")
    is_head = (order == F.struct(F.col("_head.i").alias("i"), F.col("_head.k").alias("k"), F.col("_head.t").alias("t")))
    x = x.withColumn("_to", F.explode(F.when(is_head, F.array(
        F.struct(F.col("_range").alias("r"), F.lit(False).alias("guest")),
        F.struct(F.col("_head.p").alias("r"), F.lit(True).alias("guest"))))
        .otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("guest"))))))
    w = Window.partitionBy("_to.r").orderBy(F.col("_to.guest"), F.col("_order").desc())
    x = x.withColumn("_order", order)
    following = F.lead(F.struct(*payload)).over(w)
    x = x.withColumn("_next", following).where(~F.col("_to.guest"))
    return x.select(*df.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in payload])


def _heads_of(x: DataFrame, order: Column) -> list:
    """(range, its first row's order) of all ranges: at most ``MAX_RANGES`` + 1 rows."""
    got = x.groupBy("_range").agg(F.max(order).alias("o")).collect()
    return [(r["_range"], (r["o"]["i"], r["o"]["k"], r["o"]["t"])) for r in got]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``anchors`` (array of hash and place)."""
    x = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return anchors_of(x, F.col("_text"), "anchors").select(id_col, "anchors")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # anchors are found after the shuffle, which carries the texts alone
    x = with_next(docs, "doc_id", ["text"], "text", docs.count())
    x = anchors_of(anchors_of(x, F.col("text"), "a"), F.col("next_text"), "next_a")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    x = x.withColumn("n_chars", n.cast("long")) \
        .withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))
    x = anchors_of(x, F.col("edited"), "e")
    return x.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                    fingerprint_text(F.col("a")).alias("fingerprint"), fingerprint_text(F.col("e")).alias("edited_fingerprint"),
                    F.round(likeness(F.col("a"), F.col("e")), 6).alias("near_edited"),
                    F.round(likeness(F.col("a"), F.col("next_a")), 6).alias("near_next"))
