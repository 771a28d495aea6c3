"""Importance resampling towards a target distribution of hashed word n-grams.

A text's features are all runs of one to three of its words; a feature falls into one of
``BUCKETS`` buckets by the crc32 of its UTF-8 bytes. The corpus and the target texts give one count
per bucket each, and the logarithm of the ratio of their smoothed shares is the bucket's gain. A
document weighs the sum of its features' gains. With a Gumbel number drawn from its id added, the
highest scores are a sample without replacement in proportion to the exponential of the weights.

Words come from one pass over the bytes: ``bytes.translate`` with a table of 256 entries lower-cases
A-Z and blanks separators, which is safe in UTF-8 because all bytes of other characters lie above
127; ``bytes.split`` yields the words. The crc32 of a run continues that of the run without its
last word, which is passed as the seed, so no run is ever joined. Each task adds its buckets to a
``Counter``, of at most ``BUCKETS`` entries, and Spark sums those.

Long texts are translated and split in pieces of about ``PIECE`` bytes with two words carried over.
The corpus is read twice (counts, weights); the weights are written once as narrow rows. Ranks
come from counts of score ranges: ranges above the cut are sorted one by one, the others pass
straight through. Only the gains (``BUCKETS`` numbers) and the bounds of ``RANGES`` ranges are in
the driver.

Edge cases: a NULL or blank text has no features and weighs 0; a NULL id draws as an empty one and
ranks after others of its score; repeated rows are documents of their own, each with its rank;
without documents or target texts the counts are 0 and the formula holds; an empty table gives an
empty result; other columns are not read by ``resample`` and kept as they are by ``drawn_documents``.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscope.llm.common import table
from cellscope.session import scratch_path

BUCKETS = 10_000
MAX_N = 3
MIN_WORDS = 20
DRAW_PERCENT = 5
SEED = 42
PIECE = 1 << 20
RANGES = 1024            # of scores, for ranking

#: Digits and letters stay, A-Z become a-z, bytes of other characters stay, all else is blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes, limit: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``limit`` bytes of text."""
    text = text.translate(TABLE)
    start = 0
    while start < len(text):
        end = len(text) if len(text) - start <= limit else text.find(b" ", start + limit)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def feature_codes(text: bytes, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(number of new words, the crc32 of all features that end in them) for each piece."""
    last: list[bytes] = []
    for words in pieces(text, limit):
        if not words:
            continue
        k = len(last)
        run = last + words
        spaced = [b" " + w for w in run]
        codes = level = list(map(crc32, run))
        found = codes[k:]
        for n in range(2, MAX_N + 1):
            # a run of n words continues the one of its first n - 1
            level = list(map(crc32, spaced[n - 1:], level))
            found += level[max(0, k - n + 1):]
        yield len(words), np.array(found, np.uint32)
        last = run[-(MAX_N - 1):]


def texts_of(column: pa.Array) -> Iterator[bytes]:
    for v in column.cast(pa.large_binary()):
        yield v.as_py() or b""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[int] = Counter()
    for batch in batches:
        for text in texts_of(batch.column(0)):
            for _, codes in feature_codes(text):
                counts.update((codes % BUCKETS).tolist())
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"])


def bucket_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n) over all texts; each task gives BUCKETS rows at most."""
    return df.select(F.col(text_col).alias("_text")).mapInArrow(_count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> list[int]:
    """The gain of each bucket, from two tables (bucket, n)."""
    s, t = ([0] * BUCKETS for _ in range(2))
    for counts, of in ((s, raw), (t, target)):
        for r in of.collect():  # BUCKETS rows at most
            counts[r["bucket"]] = r["n"]
    all_s, all_t = sum(s), sum(t)
    return [math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + BUCKETS) / (float(s[b] + 1) * float(all_t + BUCKETS))))
            for b in range(BUCKETS)]


def _weigh(gain: list[int], k: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = np.array(gain, np.int64)
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in texts_of(batch.column(k)):
                words = features = total = 0
                for new, codes in feature_codes(text):
                    words += new
                    features += len(codes)
                    total += int(each[codes % BUCKETS].sum())
                n_words.append(words)
                n_features.append(features)
                weight.append(total)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:k], *[pa.array(v, pa.int64()) for v in (n_words, n_features, weight)]],
                [*names, "n_words", "n_features", "weight"])
    return run


def gumbel(id_col: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number drawn from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000) * F.log(-F.log(u))).cast("long")


def weighed(df: DataFrame, target: DataFrame, keep: list[str], id_col: str, text_col: str, seed: int) -> DataFrame:
    """The columns ``keep`` as c0, c1, ... with n_words, n_features, weight, score; written once."""
    names = [f"c{i}" for i in range(len(keep))]
    gain = gains(bucket_counts(df, text_col), bucket_counts(target, "text"))
    x = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], gumbel(F.col(id_col), seed).alias("g"),
                  F.col(text_col).alias("_text"))
    names.append("g")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields[:-1]]
    got = x.mapInArrow(_weigh(gain, len(names), names), ", ".join([*kinds, "n_words bigint, n_features bigint, weight bigint"]))
    path = scratch_path(df.sparkSession, "weighed")
    got.withColumn("score", F.col("weight") + F.col("g")).drop("g").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drawn(rows: DataFrame, id_col: str, percent: int = DRAW_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds rank: 1, 2, 3, ... for the ``percent`` of the rows with enough words that have the
    highest scores, ties by smaller id, NULL for all others. Rows are told apart by ranges of
    their scores; only those that reach above the cut are sorted, each in a task of its own."""
    can = F.col("n_words") >= min_words
    # bounds where the cut may lie and above; all that is below them is one range
    shares = [i / RANGES for i in range(1, RANGES) if 100 * i >= RANGES * (100 - 2 * percent)]
    bounds = sorted(set(rows.where(can).approxQuantile("score", shares, 0.25 / RANGES))) if shares else []
    at = F.size(F.filter(F.from_json(F.lit(json.dumps(bounds)), "array<double>"), lambda b: b <= F.col("score")))
    x = rows.withColumn("_range", at)
    held = {r["_range"]: r["n"] for r in x.where(can).groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}  # RANGES rows
    left = sum(held.values()) * percent // 100
    before, higher = 0, {}      # range above the cut -> rows in higher ranges
    for k in sorted(held, reverse=True):
        if before >= left:
            break
        higher[k] = before
        before += held[k]
    above = can & F.col("_range").isin(*higher) if higher else F.lit(False)
    start = F.create_map(*[F.lit(v).cast("long") for item in higher.items() for v in item]) if higher else \
        F.create_map().cast("map<bigint,bigint>")
    order = Window.partitionBy("_range").orderBy(F.col("score").desc(), F.col(id_col).asc_nulls_last())
    rank = F.row_number().over(order) + F.try_element_at(start, F.col("_range").cast("long"))
    top = x.where(above).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= left, F.col("rank")))
    return x.where(~above).withColumn("rank", F.lit(None).cast("long")).unionByName(top).drop("_range")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = DRAW_PERCENT,
             min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_words, n_features, weight, score, rank (NULL if not
    drawn). ``target`` has the texts to resemble in its column ``text``."""
    return drawn(weighed(df, target, [id_col], id_col, text_col, seed), "c0", percent, min_words).withColumnRenamed("c0", id_col)


def drawn_documents(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = DRAW_PERCENT,
                    min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows, with all columns of ``df`` as they are."""
    names = [f"c{i}" for i in range(len(df.columns))]
    got = drawn(weighed(df, target, df.columns, id_col, text_col, seed), names[df.columns.index(id_col)], percent, min_words)
    return got.where("rank is not null").select(*names).toDF(*df.columns)


def op12(spark, sf_dir: str) -> DataFrame:
    got = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")
