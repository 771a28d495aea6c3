"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is rendered as ``<|turn|>role<|text|>text<|end|>``; inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so no marker can occur there and reading back is exact.

Prefix sums of the turns' tokens choose the windows. They are taken after the system turn and cut
into cells of ``C`` tokens; the turns that begin in a cell are a window. The last of them may reach
over the cell's end: it stays if all of them fit beside the system turn, else it is a window of its
own. A later window repeats the system turn and, of the turns before it, the last ones that fit into
what is left, at most ``history`` tokens; repeated turns stay out of the loss mask, so each assistant
text is a target once. ``C`` is what the system turn and a full history leave of the budget; where
that is less than a quarter, new turns may take a quarter or all that the system turn leaves. So a
window exceeds ``budget`` only where one turn and the system turn together do. Window numbers rise,
with gaps.

Tokens are estimated by a fixed pattern, plus four for the markers of a turn. Prefix sums are
taken in two levels (inside blocks of ``BLOCK`` turn numbers, then over the blocks), so a
conversation with a third of all rows is not ordered in one task.

Edge cases: NULL roles and texts count as empty; turns with equal numbers are ordered by role,
then text, NULL numbers first; repeated rows are turns of their own; rows with a NULL id form one
conversation; an empty table gives no windows; extra columns are not read. ``read_back`` gathers
a conversation's text in one value, which a digest of the whole conversation needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscope.llm.common import let, prefix_sums, table

BUDGET = 1024
HISTORY = 256
BLOCK = 256
MARKERS = 4  # tokens of a turn's markers
TOKEN = r"[A-Za-z]{1,6}|[0-9]{1,3}|[^A-Za-z0-9\x20\x09-\x0D]"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def head(role: Column) -> Column:
    return F.concat(F.lit(TURN), escape(role), F.lit(TEXT))


def tokens(role: Column, text: Column) -> Column:
    return (F.regexp_count(text, F.lit(TOKEN)) + F.regexp_count(role, F.lit(TOKEN)) + MARKERS).cast("long")


def placed_turns(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns with their place: begin and end (prefix sums of tokens after the system turn), the
    room that the system turn leaves and the tokens of a cell (one where it leaves nothing), the
    system turn of their conversation and whether they are it."""
    x = turns.withColumn("n", tokens(F.col("role"), F.col("text"))) \
        .withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK).cast("long"))
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    x = x.withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    is_system = F.col("role") == "system"
    first = F.struct(F.coalesce("turn", F.lit(-2**63)).alias("t"), "role", "text")
    blocks = x.groupBy("conv", "block").agg(
        F.sum("n").alias("n_block"), F.min(F.struct(first["t"].alias("t"), F.col("role").alias("role"))).alias("lead"),
        F.min(F.when(is_system, F.struct(first["t"].alias("t"), F.col("text").alias("text"), F.col("n").alias("n")))).alias("sys"))
    by = Window.partitionBy("conv")
    blocks = blocks.select(
        F.col("conv").alias("c"), F.col("block").alias("b"),
        F.coalesce(F.sum("n_block").over(by.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"),
        F.min("lead").over(by).alias("lead"), F.min("sys").over(by).alias("sys"))
    blocks = blocks.withColumn("sys", F.when(F.col("lead.role") == "system", F.col("sys")))
    blocks = blocks.withColumn("n_sys", F.coalesce("sys.n", F.lit(0).cast("long"))) \
        .withColumn("room", F.greatest(F.lit(budget) - F.col("n_sys"), F.lit(1))) \
        .withColumn("cell", F.greatest(F.col("room") - history, F.least("room", F.lit(max(budget // 4, 1)))))
    x = x.join(blocks, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    end = F.col("before") + F.col("upto") - F.col("n_sys")
    return x.select("conv", "role", "text", (end - F.col("n")).alias("begin"), end.alias("end"),
                    F.col("room").cast("long").alias("room"), F.col("cell").cast("long").alias("cell"),
                    (F.col("sys").isNotNull() & (end == 0)).alias("is_sys"),
                    F.when(F.col("sys").isNotNull(), F.struct(F.lit("system").alias("role"), F.col("sys.text").alias("text"))).alias("sys"))


def windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a window: conv_col, window, formatted, n_repeated (leading turns that were targets
    or context before), loss (array of start, end in code points of ``formatted``)."""
    turns = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                      F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    x = placed_turns(turns, budget, history)
    own = F.floor(F.greatest("begin", F.lit(0)) / F.col("cell"))
    # a window that may repeat a turn begins at its end or later, at most ``history`` tokens after its begin
    reach = F.floor((F.col("begin") + F.least(F.lit(history), "room")) / F.col("cell"))
    later = F.greatest(F.floor(F.col("end") / F.col("cell")), own + 1)
    x = x.withColumn("in", F.explode(F.concat(F.array(own), F.when(
        ~F.col("is_sys") & (later <= reach), F.sequence(later, reach)).otherwise(F.array().cast("array<bigint>")))))
    # a cell holds at most ``budget`` tokens of its own turns but for the last, and ``history`` of turns before
    got = x.groupBy("conv", F.col("in").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("begin", "end", "role", "text", "is_sys"))).alias("all"),
        F.first("sys").alias("sys"), F.first("room").alias("room"), F.first("cell").alias("cell"))
    low, high = F.col("k") * F.col("cell"), (F.col("k") + 1) * F.col("cell")
    got = got.withColumn("mine", F.filter("all", lambda t: ~t["is_sys"] & (t["begin"] >= low))).withColumn("last", F.try_element_at("mine", F.lit(-1)))
    start = F.coalesce(F.get("mine", F.lit(0))["begin"], F.lit(0).cast("long"))
    stop = F.coalesce(F.col("last.end"), F.lit(0).cast("long"))
    apart = F.coalesce((F.size("mine") > 1) & (F.col("last.end") > high) & (stop - start > F.col("room")), F.lit(False))
    span = lambda w, a, b: F.struct(w.alias("w"), a.alias("start"), b.alias("stop"),
                                    F.least(F.lit(history), F.greatest(F.col("room") - (b - a), F.lit(0))).alias("left"))
    got = got.where((F.size("mine") > 0) | F.exists("all", lambda t: t["is_sys"])).withColumn("span", F.explode(F.when(apart, F.array(
        span(F.col("k") * 2, start, F.col("last.begin")), span(F.col("k") * 2 + 1, F.col("last.begin"), stop)))
        .otherwise(F.array(span(F.col("k") * 2, start, stop)))))
    new = lambda t: F.when(t["is_sys"], F.col("span.w") == 0).otherwise(
        (t["begin"] >= F.col("span.start")) & (t["end"] <= F.col("span.stop")))
    again = lambda t: ~t["is_sys"] & (t["end"] <= F.col("span.start")) & (t["begin"] >= F.col("span.start") - F.col("span.left"))
    got = got.select("conv", F.col("span.w").alias("w"), "sys", F.transform(
        F.filter("all", lambda t: new(t) | again(t)),
        lambda t: F.struct(t["begin"].alias("begin"), t["role"].alias("role"), t["text"].alias("text"), again(t).alias("repeated"))).alias("turns"))
    got = got.withColumn("turns", F.concat(
        F.when((F.col("w") > 0) & F.col("sys").isNotNull(), F.array(F.struct(
            F.lit(-1).cast("long").alias("begin"), F.col("sys.role").alias("role"), F.col("sys.text").alias("text"), F.lit(True).alias("repeated"))))
        .otherwise(F.slice("turns", 1, 0)), F.col("turns")))
    got = got.withColumn("parts", F.transform("turns", lambda t: F.struct(
        head(t["role"]).alias("head"), escape(t["text"]).alias("body"), ((t["role"] == "assistant") & ~t["repeated"]).alias("target"))))
    whole = lambda p: F.concat(p["head"], p["body"], F.lit(END))
    got = got.withColumn("formatted", F.array_join(F.transform("parts", whole), ""))
    starts = prefix_sums(F.transform("parts", lambda p: F.char_length(whole(p)).cast("long")))
    got = got.withColumn("loss", let(starts, lambda at: F.transform(
        F.filter(F.transform("parts", lambda p, i: F.struct(
            (F.get(at, i) + F.char_length(p["head"])).alias("start"),
            (F.get(at, i) + F.char_length(p["head"]) + F.char_length(p["body"])).alias("end"), p["target"].alias("target"))),
            lambda s: s["target"]), lambda s: F.struct(s["start"], s["end"]))))
    return got.select(F.col("conv").alias(conv_col), F.col("w").alias("window"), "formatted",
                      F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """From windows: per window its new turns (role, text) and the texts under the loss mask."""
    parse = r"(?s)^<\|turn\|>(.*?)<\|text\|>(.*)$"
    pieces = F.split("formatted", r"<\|end\|>", -1)
    x = formatted.withColumn("pieces", F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated")))
    x = x.withColumn("turns", F.transform("pieces", lambda p: F.struct(
        unescape(F.regexp_extract(p, parse, 1)).alias("role"), unescape(F.regexp_extract(p, parse, 2)).alias("text"))))
    return x.withColumn("targets", F.transform("loss", lambda s: unescape(
        F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))).drop("pieces")


EXTRA_ID = -7
EXTRA_TEXT = r"\### Assistant: </turn> ok"


def op2(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user")
                                  .otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    x = read_back(windows(turns.unionByName(extra)))
    x = x.select("conv_id", F.struct(
        "window", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.size("turns").cast("long").alias("n"), F.array_join("targets", "").alias("loss"),
        F.char_length("formatted").cast("long").alias("chars")).alias("s"))
    g = x.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    whole = lambda f: F.array_join(F.transform("s", lambda s: s[f]), "")
    add = lambda f: F.aggregate("s", F.lit(0).cast("long"), lambda a, s: a + s[f])
    return g.select("conv_id", add("n").alias("n_turns"), F.sha2(whole("turns"), 256).alias("turns_sha256"),
                    F.char_length(whole("loss")).cast("long").alias("loss_chars"), F.sha2(whole("loss"), 256).alias("loss_sha256"),
                    add("chars").alias("formatted_chars"), F.size("s").cast("long").alias("n_windows"))


SQL = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '{EXTRA_TEXT}' union all select -7, 1, 'assistant', '{EXTRA_TEXT}'),
n as (select *, len(regexp_extract_all(text, '{TOKEN}')) + len(regexp_extract_all(role, '{TOKEN}')) + {MARKERS} as n,
             length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + 23 as chars
      from t),
o as (select *, row_number() over k as rn, cast(sum(n) over (k rows unbounded preceding) as bigint) as upto,
             first_value(role) over k as lead_role, first_value(n) over k as lead_n, first_value(chars) over k as lead_chars
      from n window k as (partition by conv_id order by turn nulls first, role, text)),
s as (select *, lead_role = 'system' as has_sys, lead_role = 'system' and rn = 1 as is_sys,
             case when lead_role = 'system' then lead_n else 0 end as n_sys, greatest({BUDGET} - n_sys, 1) as room,
             greatest(room - {HISTORY}, least(room, {BUDGET // 4})) as cell, upto - n_sys as e, e - n as b from o),
k as (select *, greatest(b, 0) // cell as k, count(*) filter (not is_sys) over g as turns_in, max(e) over g - min(greatest(b, 0)) over g as own
      from s window g as (partition by conv_id, greatest(b, 0) // cell)),
w as (select *, 2 * k + case when turns_in > 1 and e > (k + 1) * cell and own > room then 1 else 0 end as w from k),
win as (select conv_id, w, min(greatest(b, 0)) as start, least({HISTORY}, greatest(any_value(room) - (max(e) - start), 0)) as rest,
               any_value(case when w > 0 and has_sys then lead_chars else 0 end) as sys_chars from w group by conv_id, w),
again as (select win.conv_id, sum(chars) as chars from win join w on win.conv_id is not distinct from w.conv_id
          and not w.is_sys and w.e <= win.start and w.b >= win.start - win.rest group by win.conv_id),
c as (select conv_id, cast(count(*) as bigint) as n_turns,
             sha256(string_agg(role || chr(10) || text || chr(10), '' order by rn)) as turns_sha256,
             cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
             sha256(coalesce(string_agg(text, '' order by rn) filter (role = 'assistant'), '')) as loss_sha256,
             sum(chars) as chars from w group by conv_id)
select c.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
       cast(chars + (select sum(sys_chars) from win where win.conv_id is not distinct from c.conv_id)
            + coalesce((select chars from again where again.conv_id is not distinct from c.conv_id), 0) as bigint) as formatted_chars,
       (select count(*) from win where win.conv_id is not distinct from c.conv_id) as n_windows
from c
"""
