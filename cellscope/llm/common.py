"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the package: space and \x09-\x0D, as a Java/RE2 class and as characters.
SEPARATORS = r"[\x20\x09-\x0D]+"
SEPARATOR_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: a one-element array is mapped, so inside
    ``body`` the value is a lambda variable and not an expression that Catalyst repeats."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """The words of a text (NULL counts as empty)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATOR_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATORS))


def total(values: Column) -> Column:
    """Sum of an array of longs; 0 for an empty one."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``."""
    from cellscope.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


BLOCK = 256


def prefix_sums(sizes: Column) -> Column:
    """Sum of all earlier values for each place of an array of longs, in two levels, so that
    the work on n values is about n * BLOCK / 2 and not n * n / 2."""
    def of(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")),
                             lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        return let(blocks, lambda parts: let(
            F.transform(parts, total), lambda sums: F.flatten(F.transform(parts, lambda part, b: let(
                total(F.slice(sums, F.lit(1), b)), lambda off: F.transform(
                    part, lambda _, i: off + total(F.slice(part, F.lit(1), i))))))))
    return F.when(F.size(sizes) > 0, let(sizes, of)).otherwise(F.array().cast("array<bigint>"))
