"""Personal data by proposal, checksum and context, in DataFrame functions only.

Regular expressions propose spans; validators confirm them (Luhn for card numbers, mod-97 for
bank accounts, value ranges for addresses, digit counts for phone numbers); words near a span
raise or lower its score. The base kinds always stay, whatever their score; the added kinds
(``iban``, and ``national_id`` and ``local_phone``, which have no checksum) count from
``MIN_SCORE``.

Places come from splitting a text at its matches: a match starts after all pieces and matches
before it. Expressions start only where a run of their characters starts and use possessive
repeats, so a text without a match costs a time proportional to its length.

Edge cases: a NULL or empty text has no spans; rows are judged one by one, so repeated rows and
NULL ids give rows of their own; an empty table gives an empty result; only ``id_col`` and
``text_col`` are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscope.llm.common import count_kind, let, prefix_sums, spans_text, table

CONTEXT = 40       # code points on either side of a span whose words adjust its score
MIN_SCORE = 0.6
RAISE, LOWER = 0.3, 0.3


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, F.lit("[^0-9]"), F.lit(""))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def step(a, i):
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return a + F.when(i % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, letters as 10 to 35 and its first four signs last, is 1 mod 97."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(a, i):
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """``hint`` is a cheap condition that every text with a match meets."""
    name: str
    pattern: str
    hint: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    near: str        # words that raise the score
    score: float     # before context
    base: bool = False


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _words(*choices: str) -> str:
    """One of these words, between signs that are not ASCII letters, digits or underscores."""
    return f"(?i)(^|[^A-Za-z0-9_])({'|'.join(choices)})($|[^A-Za-z0-9_])"


AGAINST = _words("order", "invoice", "version", "isbn", "part no", "example", "bestellnummer", "commande", "pedido")
PHONE_WORDS = _words("phone", "tel", "telephone", "mobile", "call", "fax", "telefon", "handy", r"t\x{00E9}l\x{00E9}phone",
                     r"tel\x{00E9}fono", r"m\x{00F3}vil")

#: In the listed order: the base kinds first.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), _words("e-?mail", "contact", "correo", "courriel"), 0.9, True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda t: F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]"),
         lambda m: m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"), _words("ip", "host", "server", "address", "adresse"), 0.7, True),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
         lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
         lambda m: F.length(_digits(m)).between(13, 19) & luhn(_digits(m)), _words("card", "visa", "credit", "karte", "carte", "tarjeta"), 0.8, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda t: F.contains(t, F.lit("+")) & t.rlike(r"\+[0-9]"),
         lambda m: F.length(_digits(m)).between(9, 15), PHONE_WORDS, 0.7, True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])",
         lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"), mod97, _words("iban", "bank", "account", "konto", "compte", "cuenta"), 0.8),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda m: ~m.rlike("^(000|666|9)"),
         _words("ssn", "social security", "national id"), 0.4),
    Kind("local_phone", r"(?<![0-9+()-])(?:\([0-9]{3}\)\x20?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])",
         lambda t: t.rlike(r"[0-9]{3}-[0-9]{4}"), lambda m: F.lit(True), PHONE_WORDS, 0.4),
)

def proposals(text: Column, kind: Kind) -> Column:
    """All matches in a text: array of (start, end, match), by start."""
    pattern = F.lit(kind.pattern)

    def place(found):
        pieces = F.split(text, kind.pattern, -1)
        sizes = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found,
                           lambda p, m: (F.char_length(p) + F.char_length(m)).cast("long"))
        return let(pieces, lambda cut: let(prefix_sums(sizes), lambda before: F.transform(
            found, lambda m, i: let(F.get(before, i) + F.char_length(F.get(cut, i)), lambda a: F.struct(
                a.alias("start"), (a + F.char_length(m)).alias("end"), m.alias("match"))))))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return F.when(kind.hint(text), let(F.regexp_extract_all(text, pattern, F.lit(0)),
                                       lambda found: F.when(F.size(found) > 0, place(found)).otherwise(none))).otherwise(none)


def scored(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind: array of (kind, start, end, score)."""
    def one(s):
        a = F.greatest(F.lit(0), s["start"] - CONTEXT)
        around = F.concat_ws(" ", F.substr(text, (a + 1).cast("int"), (s["start"] - a).cast("int")),
                             F.substr(text, (s["end"] + 1).cast("int"), F.lit(CONTEXT)))
        return let(around, lambda near: F.struct(
            F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(kind.score)
                    + F.when(near.rlike(kind.near), RAISE).otherwise(0.0)
                    - F.when(near.rlike(AGAINST), LOWER).otherwise(0.0))).alias("score")))
    return F.transform(F.filter(proposals(text, kind), lambda s: kind.valid(s["match"])), one)


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and ``spans`` (kind, start, end in code points, end
    exclusive, score; by kind as listed, then start)."""
    x = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    for k in KINDS:
        x = x.withColumn(f"_{k.name}", scored(F.col("_text"), k))
    parts = [F.col(f"_{k.name}") if k.base else F.filter(f"_{k.name}", lambda s: s["score"] >= MIN_SCORE) for k in KINDS]
    return x.select(id_col, F.concat(*parts).alias("spans"))


def op5(spark, sf_dir: str) -> DataFrame:
    got = find_personal_data(table(spark, sf_dir, "documents"))
    base = [k.name for k in KINDS if k.base]
    spans = F.col("spans")
    return got.select(
        "doc_id", *[count_kind(spans, k).alias(f"n_{k}") for k in base],
        F.sha2(spans_text(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"))


#: How DuckDB finds and confirms each kind: a pattern without look-around, a condition on the
#: match ``h``, its digits ``g``, and the signs before and after it, ``p`` and ``n``.
_LUHN = ("list_sum(list_transform(range(length(g)), lambda i: case when i % 2 = 0 then cast(g[length(g) - i] as int) "
         "else cast(g[length(g) - i] as int) * 2 - case when cast(g[length(g) - i] as int) > 4 then 9 else 0 end end)) % 10 = 0")
_TURNED = "(substr(h, 5) || substr(h, 1, 4))"
_MOD97 = (f"list_reduce(list_concat([0], list_transform(range(length(h)), lambda i: ascii({_TURNED}[i + 1]))), lambda a, c: "
          "case when c >= 65 then (a * 100 + c - 55) % 97 else (a * 10 + c - 48) % 97 end) = 1")
_SQL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", rf"regexp_full_match(h, '{_PART}\.{_PART}\.{_PART}\.{_PART}')"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length(g) between 13 and 19 and {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(g) between 9 and 15"),
    "iban": (r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", f"not regexp_matches(p, '[A-Za-z0-9]') and not regexp_matches(n, '[A-Za-z0-9]') and {_MOD97}"),
    "national_id": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "not regexp_matches(p, '[0-9-]') and not regexp_matches(n, '[0-9-]') and not regexp_matches(h, '^(000|666|9)')"),
    "local_phone": (r"(?:\([0-9]{3}\)\x20?|[0-9]{3}-)[0-9]{3}-[0-9]{4}", "not regexp_matches(p, '[0-9+()-]') and not regexp_matches(n, '[0-9-]')"),
}


def _kind_sql(rank: int, kind: Kind) -> str:
    pattern, valid = _SQL_KINDS[kind.name]
    keep = "true" if kind.base else f"score >= {MIN_SCORE}"
    return f"""select rid, {rank} as rank, '{kind.name}' as kind, s, e from (
    select *, {kind.score} + case when regexp_matches(around, '{kind.near}') then {RAISE} else 0 end
              - case when regexp_matches(around, '{AGAINST}') then {LOWER} else 0 end as score
    from (select rid, h, g, s, e, case when s > 0 then text[s] else '' end as p, text[e + 1] as n,
                 substr(text, greatest(0, s - {CONTEXT}) + 1, s - greatest(0, s - {CONTEXT})) || ' ' || substr(text, e + 1, {CONTEXT}) as around
          from (select rid, text, h, regexp_replace(h, '[^0-9]', '', 'g') as g, upto - length(h) as s, upto as e
                from (select rid, text, h, cast(sum(length(piece) + length(h)) over (partition by rid order by i) as bigint) as upto
                      from (select rid, text, unnest(hits) as h, unnest(pieces[1:len(hits)]) as piece, generate_subscripts(hits, 1) as i
                            from (select rid, text, regexp_extract_all(text, '{pattern}') as hits, string_split_regex(text, '{pattern}') as pieces from d)
                            where len(hits) > 0))))
    where {valid}) where {keep}"""


_BASE = [k.name for k in KINDS if k.base]
SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
m as ({" union all ".join(_kind_sql(k, kind) for k, kind in enumerate(KINDS))}),
g as (select rid, {", ".join(f"count_if(kind = '{k}') as n_{k}" for k in _BASE)},
        string_agg(kind || ':' || s || ':' || e, ',' order by rank, s) filter (rank < {len(_BASE)}) as base,
        string_agg(kind || ':' || s || ':' || e, ',' order by rank, s) as spans
      from m group by rid)
select doc_id, {", ".join(f"cast(coalesce(n_{k}, 0) as bigint) as n_{k}" for k in _BASE)},
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (rid)
"""
