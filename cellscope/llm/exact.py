"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

Texts are equal when identical after the separators (space, \\x09-\\x0D) are deleted. One scan of
the texts writes a narrow row each: the SHA-256 of the normalised text, the code points of the
original, the id. The texts themselves never shuffle.

Pass 1 counts, over all rows, the insertions into the cells of a blocked Bloom filter and keeps as
set bits the cells that were hit at least twice. Pass 2 tests every row: equal texts hit the same
``HASHES`` cells of one block, so a row with a cell that was hit once has no equal and passes
straight through. Only rows with all cells set are shuffled by their SHA-256, where the few that
collided in the filter prove to be alone.

The filter has ``BITS_PER_ROW`` cells a row, by which about one row in seventy shuffles needlessly,
and ``MAX_FILTER_BITS`` at most (64 MB, the bound of its broadcast). A larger corpus fills it
more: more rows shuffle (narrow ones), with the same results.

Of equal texts the row with the most code points stays, then the one with the smallest id (NULL
last). Groups are combined in the tasks before they shuffle. A group with more than one in
``HOT_SHARE`` of all rows gets its result by a broadcast of at most ``HOT_SHARE`` such groups,
so the join that brings results back to rows never has a key with more rows than that.

Edge cases: a NULL text counts as empty, blank texts equal the empty one; rows alike in id and
length are told apart by their number, so that exactly one row of a group stays; a group of NULL
ids only has a NULL keep_id; an empty table gives an empty result; other columns are not read by
``mark_copies`` and kept as they are by ``drop_copies``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscope.llm.common import SEPARATOR_CHARS, checkpointed, table
from cellscope.session import scratch_path

HASHES = 2
BITS_PER_ROW = 16
BLOCK_BITS = 4096
MAX_FILTER_BITS = 1 << 29
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SEPARATOR_CHARS, "")


def digests(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, row, n_chars, sha, h): written once and read again, so ``row`` is a fixed number."""
    rows = df.select(F.col(id_col).alias("id"), F.char_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_chars"),
                     F.sha2(normalised(F.col(text_col)), 256).alias("sha"), *keep)
    path = scratch_path(df.sparkSession, "digests")
    rows.withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("sha")).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def filter_blocks(n_rows: int) -> int:
    """Blocks of a filter for so many rows: a power of two."""
    bits = min(MAX_FILTER_BITS, max(BLOCK_BITS, n_rows * BITS_PER_ROW))
    return 1 << (bits // BLOCK_BITS - 1).bit_length() if bits > BLOCK_BITS else 1


def block_of(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def cells_of(h: Column) -> list[Column]:
    """The cells of a hash in its block, from bits that do not choose the block."""
    width = BLOCK_BITS.bit_length() - 1
    return [F.pmod(F.shiftrightunsigned(h, 64 - width * (i + 1)), F.lit(BLOCK_BITS)).cast("int") for i in range(HASHES)]


def hit_twice(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, words): pass 1. The cells of each block with two insertions or more, as 64-bit
    words; at most BLOCK_BITS / 64 of them are gathered a block."""
    h = F.col("h")
    cells = hashes.select(block_of(h, blocks).alias("block"), F.explode(F.array_distinct(F.array(*cells_of(h)))).alias("cell"))
    twice = cells.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("hits")).where("hits > 1")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("cell", F.lit(64)).cast("int"))
    words = twice.groupBy("block", F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    held = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    every = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda w: F.coalesce(F.try_element_at("held", w), F.lit(0).cast("long")))
    return held.select(F.col("block").alias("_block"), every.alias("_words"))


def possibly_repeated(rows: DataFrame, n_rows: int) -> DataFrame:
    """Pass 2: ``rows`` with ``repeated``, false only where no other row has the text."""
    blocks = filter_blocks(n_rows)
    bits = checkpointed(hit_twice(rows.select("h"), blocks))
    x = rows.join(F.broadcast(bits), block_of(F.col("h"), blocks) == F.col("_block"), "left")
    is_set = [F.getbit(F.get("_words", F.shiftright(c, 6)), F.pmod(c, F.lit(64)).cast("int")) == 1 for c in cells_of(F.col("h"))]
    return x.withColumn("repeated", F.coalesce(reduce(and_, is_set), F.lit(False))).drop("_block", "_words")


def copies(rows: DataFrame) -> DataFrame:
    """``rows`` (id, row, n_chars, sha, h, ...) with keep_id, group_size, kept."""
    n_rows = rows.count()
    x = possibly_repeated(rows, n_rows)
    alone = x.where("not repeated").select(*rows.columns, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                           F.lit(True).alias("kept"))
    some = x.where("repeated").drop("repeated")
    first = F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    groups = some.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("_first")) \
        .select(F.col("sha").alias("_sha"), "group_size", F.col("_first.id").alias("keep_id"), F.col("_first.row").alias("_row"))
    hot = F.col("group_size") * HOT_SHARE > n_rows         # fewer than HOT_SHARE groups can be
    marked = some.join(F.broadcast(groups.where(hot)), F.col("sha") == F.col("_sha"), "left")
    done = marked.where("_sha is not null").drop("_sha")
    rest = marked.where("_sha is null").select(*rows.columns).join(groups.where(~hot), F.col("sha") == F.col("_sha")).drop("_sha")
    named = done.unionByName(rest).withColumn("kept", F.col("row") == F.col("_row")).drop("_row")
    return alone.unionByName(named)


def mark_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, keep_id (the row that stays), group_size, kept,
    text_sha256 (of the normalised text)."""
    got = copies(digests(df, id_col, text_col))
    return got.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of ``df`` as they are."""
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    got = copies(digests(plain, names[df.columns.index(id_col)], names[df.columns.index(text_col)], tuple(names)))
    return got.where("kept").select(*names).toDF(*df.columns)


def op13(spark, sf_dir: str) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as s
           from documents)
select doc_id, first_value(doc_id) over best as keep_id, cast(count(*) over (partition by s) as bigint) as group_size,
       row_number() over best = 1 as kept, s as text_sha256
from d window best as (partition by s order by n desc, doc_id nulls last)
"""
