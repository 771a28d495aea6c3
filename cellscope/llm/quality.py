"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: symbol noise, navigation bars, shouting, a word repeated over
and over, boilerplate, and missing end punctuation. Failing lines are removed, and a document
that loses more than ``MAX_LOST`` of its word characters is rejected, as is one that fails the
base rules (under ten words, or over a fifth of the words inside repeated 5-word windows).

Edge cases: a NULL or blank text has no words and fails the base rules; blank lines are kept
and cost nothing; rows are judged one by one, so repeated rows, NULL ids and extra columns
change nothing; an empty table gives an empty result. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscope.llm.common import SEPARATOR_CHARS, SEPARATORS, let, table, word_array

WINDOW = 5            # words in a repeated window
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
MAX_LOST = 0.5        # share of the word characters that line cleaning may remove
MAX_SYMBOLS = 0.5     # symbol characters a word, above which a line is noise
MIN_BAR_WORDS = 0.25  # separators a word, above which a line is navigation
MIN_DISTINCT = 0.25   # distinct words a word, below which a line of ten words is repetition
MIN_PUNCT_WORDS = 5   # lines from this length need end punctuation

SYMBOLS = r"[#*$%&|<>]"
SEPARATOR_MARKS = r"[|>\x{00BB}\x{2022}\x{00B7}]"
END_MARK = r"[.!?\x{2026}:;\x{3002}][\x22\x27)\x5D\x{201D}\x{2019}\x{00BB}*#$%&]*$"
SHOUT = r"\p{Lu}{2}"
LOWER = r"\p{Ll}"
BOILERPLATE = (r"(?i)^(licensed under |all rights reserved|copyright (\(c\)|[0-9]{4})|terms of (use|service)"
               r"|privacy policy|cookie policy|this (web)?site uses cookies|accept (all )?cookies"
               r"|please enable javascript|subscribe to our newsletter|sign (in|up)$|log ?in$|share (this|on) )")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column) -> Column:
    """True for a line that cleaning removes; blank lines never fail."""
    body = F.btrim(line, F.lit(SEPARATOR_CHARS))
    words = F.split(body, SEPARATORS)
    n = F.size(words)
    symbols = _count(body, SYMBOLS) > n * F.lit(MAX_SYMBOLS)
    bar = (_count(body, SEPARATOR_MARKS) >= 2) & (_count(body, SEPARATOR_MARKS) > n * F.lit(MIN_BAR_WORDS))
    shout = (n >= MIN_PUNCT_WORDS) & body.rlike(SHOUT) & ~body.rlike(LOWER)
    dull = (n >= MIN_WORDS) & (F.size(F.array_distinct(words)) < n * F.lit(MIN_DISTINCT))
    open_end = (n >= MIN_PUNCT_WORDS) & ~body.rlike(END_MARK)
    return (body != "") & (body.rlike(BOILERPLATE) | symbols | bar | open_end | shout | dull)


def repeated_words(order: str) -> Column:
    """Words inside windows that occur twice or more. ``order`` holds the windows as sorted
    (hash, start) pairs, NULL where nothing repeats."""
    near = F.col(order)
    starts = F.array_sort(F.transform(
        F.filter(near, lambda x, i: (F.get(near, i - 1)["h"] == x["h"]).eqNullSafe(F.lit(True))
                 | (F.get(near, i + 1)["h"] == x["h"]).eqNullSafe(F.lit(True))),
        lambda x: x["i"]))
    covered = let(starts, lambda q: F.aggregate(
        F.transform(q, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(q, j + 1) - p, F.lit(WINDOW))).cast("long")),
        F.lit(0).cast("long"), lambda a, x: a + x))
    return F.when(near.isNull(), F.lit(0).cast("long")).otherwise(covered)


def measure(df: DataFrame, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The measures, the cleaned text and the verdict of every row; ``keep`` are the columns
    that stay beside them (in struct ``_row`` if none are named)."""
    keep = keep or [F.struct(*[F.col(c) for c in df.columns]).alias("_row")]
    x = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    x = x.withColumn("_words", word_array(F.col("_text")))
    x = x.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    h = F.col("_h")
    x = x.withColumn("_g", F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                    lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))))
    x = x.withColumn("_order", F.when(
        F.size(F.array_distinct("_g")) < F.size("_g"),
        F.sort_array(F.transform("_g", lambda v, i: F.struct(v.alias("h"), i.alias("i"))))))
    x = x.withColumn("_lines", F.split("_text", "\n"))
    x = x.withColumn("_full", F.filter(F.col("_lines"), lambda s: F.btrim(s, F.lit(SEPARATOR_CHARS)) != ""))
    x = x.withColumn("_kept_lines", F.filter(F.col("_lines"), lambda s: ~line_fails(s)))
    n_words = F.size("_words").cast("long")
    x = x.select(
        *[c for c in x.columns if not c.startswith("_") or c == "_row"],
        n_words.alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        repeated_words("_order").alias("n_repeat_words"),
        (F.size("_lines") - F.size("_kept_lines")).cast("long").alias("n_removed_lines"),
        F.array_join("_kept_lines", "\n").alias("cleaned_text"),
    )
    left = F.char_length(F.array_join(word_array(F.col("cleaned_text")), "")).cast("long")
    x = x.withColumn("lost_chars", F.when(F.col("n_removed_lines") == 0, F.lit(0).cast("long"))
                     .otherwise(F.col("word_chars") - left))
    x = x.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                     | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT))
    return x.withColumn("kept", ~F.col("base_failed")
                        & (F.col("lost_chars") <= F.col("word_chars") * F.lit(MAX_LOST)))


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, the measures, the verdict and the cleaned text."""
    return measure(df, text_col, [F.col(id_col)])


def clean_documents(df: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows that pass, with their columns as they were, the cleaned text, and its length."""
    # a row number in the condition keeps the filter above the measures; pushed below them it
    # would repeat all of their expressions
    got = measure(df, text_col).withColumn("_seen", F.monotonically_increasing_id()).where("kept and _seen >= 0")
    changed = F.col("n_removed_lines") > 0
    new = {text_col: F.when(changed, F.col("cleaned_text")).otherwise(F.col(f"_row.{text_col}"))}
    if chars_col in df.columns:
        new[chars_col] = F.when(changed, F.char_length("cleaned_text").cast("long")).otherwise(F.col(f"_row.{chars_col}"))
    return got.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in df.columns])


def op8(spark, sf_dir: str) -> DataFrame:
    got = quality_report(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "n_removed_lines", "lost_chars")


SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
r as (select row_number() over () as rid, doc_id, text from d),
w as (select rid, u.w as w, u.i as i from r, unnest(
        list_zip(regexp_extract_all(text, '[^\x20\x09-\x0D]+'),
                 range(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))))) as t(z),
      lateral (select z[1] as w, z[2] as i) u),
wc as (select rid, count(*) as n_words, sum(length(w)) as word_chars from w group by rid),
g as (select rid, i, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' '
        || lead(w, 3) over o || ' ' || lead(w, 4) over o as g
      from w window o as (partition by rid order by i)),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from g where g is not null) where c > 1),
cov as (select rid, sum(least(5, coalesce(nxt - i, 5))) as n_repeat_words
        from (select rid, i, lead(i) over (partition by rid order by i) as nxt from dup) group by rid),
l as (select rid, trim(line, e' \t\n\x0b\x0c\r') as body, line, pos
      from (select rid, unnest(string_split(text, chr(10))) as line,
                   generate_subscripts(string_split(text, chr(10)), 1) as pos from r)),
m as (select *, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) as n,
             len(list_distinct(regexp_extract_all(body, '[^\x20\x09-\x0D]+'))) as nd,
             len(regexp_extract_all(body, '{SYMBOLS}')) as ns,
             len(regexp_extract_all(body, '{SEPARATOR_MARKS}')) as nb from l where body <> ''),
f as (select *, regexp_matches(body, '{BOILERPLATE}') or ns > n * 0.5 or (nb >= 2 and nb > n * 0.25)
               or (n >= 5 and not regexp_matches(body, '{END_MARK}'))
               or (n >= 5 and regexp_matches(body, '{SHOUT}') and not regexp_matches(body, '{LOWER}'))
               or (n >= 10 and nd < n * 0.25) as fails from m),
lc as (select rid, count(*) - count(distinct line) as n_dup_lines, count_if(fails) as n_removed_lines,
              sum(case when fails then length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) else 0 end) as lost_chars
       from f group by rid),
a as (select doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
             cast(len(regexp_extract_all(text, '{SYMBOLS}')) as bigint) as n_symbols,
             cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
             cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
             cast(coalesce(n_removed_lines, 0) as bigint) as n_removed_lines,
             cast(coalesce(lost_chars, 0) as bigint) as lost_chars
      from r left join wc using (rid) left join cov using (rid) left join lc using (rid)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and lost_chars <= word_chars * 0.5 as kept, n_removed_lines, lost_chars
from b
"""
