"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query: what every match must
contain, as ANDs and ORs of trigrams. Texts are indexed in blocks: one numpy pass over the
bytes finds the places of the trigrams that occur in any query, and gives each its postings
(the rows of the block that hold it). A rule's candidates come from intersecting and uniting
postings, and only they are searched with the expression. A rule without mandatory trigrams
has every row as a candidate. Blocks are built inside Spark's tasks, so nothing is shuffled and
memory is bounded by ``BLOCK_BYTES`` (or by the one text that is longer).

Edge cases: a NULL or empty text has no spans; each row is scanned by itself, so repeated rows
and NULL ids give their own rows; an empty table gives an empty result; columns other than
``id_col`` and ``text_col`` are not read by ``find_secrets``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.llm.common import count_kind, spans_text, table
from cellscope.llm.shingles import text_blocks


@dataclass(frozen=True)
class Rule:
    """``least`` is the fewest characters of group ``group`` that a match must have."""
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 1


#: The base rules, in their listed order, then those the method adds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]+", least=16),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosted_git", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_hook", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_web", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE_KINDS = ("assign", "access", "hex")
MAX_STRINGS = 64  # alternatives kept while literals are joined; beyond it a literal ends

# A query is None (anything matches), a trigram (bytes), or ("and" | "or", queries).


def _and(queries: list) -> tuple | bytes | None:
    parts = {q for q in queries if q is not None}
    return None if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _or(queries: list) -> tuple | bytes | None:
    parts = set(queries)
    return None if None in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _of_strings(strings: set[str]):
    """What a text must hold that contains one of these strings."""
    grams = [{b[i:i + 3] for i in range(len(b) - 2)} for b in (s.lower().encode() for s in strings)]
    return _or([_and(list(g)) for g in grams])


def _literals(op, arg) -> set[str] | None:
    """The strings that one parsed element stands for, or None if they are too many."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg)}
    if name == "IN":
        out: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.add(chr(value))
            elif str(kind) == "RANGE" and value[1] - value[0] < MAX_STRINGS:
                out |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= MAX_STRINGS else None
    if name == "SUBPATTERN":
        return _sequence_literals(arg[-1])
    if name == "BRANCH":
        found = [_sequence_literals(branch) for branch in arg[1]]
        return None if None in found else set().union(*found)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 3:
        one = _sequence_literals(arg[2])
        if one is None:
            return None
        out = set()
        for n in range(arg[0], arg[1] + 1):
            if len(one) ** n > MAX_STRINGS:
                return None
            out |= {"".join(p) for p in product(sorted(one), repeat=n)}
        return out
    return None


def _sequence_literals(parsed) -> set[str] | None:
    out = {""}
    for op, arg in parsed:
        one = _literals(op, arg)
        if one is None or len(out) * len(one) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def _query(parsed):
    """The trigram query of a parsed sequence: joined literals as far as they stay few, and the
    queries of the elements that end them."""
    found, run = [], {""}
    for op, arg in parsed:
        one = _literals(op, arg)
        if one is not None and len(run) * len(one) <= MAX_STRINGS:
            run = {a + b for a in run for b in one}
            continue
        found.append(_of_strings(run))
        run = one if one is not None else {""}
        if one is None:
            name = str(op)
            if name == "SUBPATTERN":
                found.append(_query(arg[-1]))
            elif name == "BRANCH":
                found.append(_or([_query(branch) for branch in arg[1]]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                found.append(_query(arg[2]))
    return _and([*found, _of_strings(run)])


def trigram_query(pattern: str):
    """The Boolean trigram query (over lower-cased UTF-8) that every match of ``pattern`` meets."""
    return _query(re._parser.parse(pattern))


def _trigrams(query) -> set[bytes]:
    return set() if query is None else {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


def _candidates(query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """The rows of the block that meet the query, as a mask."""
    if query is None:
        return np.ones(n, bool)
    if isinstance(query, bytes):
        mask = np.zeros(n, bool)
        mask[postings[query]] = True
        return mask
    masks = [_candidates(q, postings, n) for q in query[1]]
    return np.logical_and.reduce(masks) if query[0] == "and" else np.logical_or.reduce(masks)


_LOWER = np.arange(256, dtype=np.int32)
_LOWER[65:91] += 32


@lru_cache(maxsize=8)
def _compiled(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(_trigrams, queries)))
    place = np.zeros(1 << 24, np.uint8 if len(grams) < 255 else np.uint16)  # 0: not in any query
    for i, g in enumerate(grams, 1):
        place[int.from_bytes(g, "big")] = i
    found = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0)) for r in rules]
    return queries, grams, place, found


def block_postings(data: np.ndarray, offsets: np.ndarray, grams: list[bytes], place: np.ndarray) -> dict[bytes, np.ndarray]:
    """The inverted index of a block over the trigrams of the queries: trigram -> rows."""
    empty = np.zeros(0, np.int64)
    if len(data) < 3:
        return dict.fromkeys(grams, empty)
    low = _LOWER[data]
    which = place[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
    at = np.flatnonzero(which)
    rows = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[rows + 1]
    which, rows = which[at[inside]], rows[inside]
    return {g: np.unique(rows[which == i]) for i, g in enumerate(grams, 1)}


def scan_block(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...]) -> list[list[tuple[str, int, int]]]:
    """The spans (kind, start, end in code points) of each row of a block, by start, then rule."""
    queries, grams, place, expressions = _compiled(rules)
    n = len(offsets) - 1
    postings = block_postings(data, offsets, grams, place)
    masks = np.array([_candidates(q, postings, n) for q in queries])
    out: list[list[tuple[str, int, int]]] = []
    for i in range(n):
        spans = []
        if offsets[i + 1] > offsets[i] and masks[:, i].any():
            text = data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")
            for k in np.flatnonzero(masks[:, i]):
                rule = rules[k]
                for m in expressions[k].finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans.append((m.start(), int(k), m.end()))
            spans.sort()
        out.append([(rules[k].kind, a, b) for a, k, b in spans])
    return out


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column(1)):
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in scan_block(data, offsets, rules)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(spans, _SPANS)], ["_id", "spans"])
    return run


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: ``id_col`` and ``spans`` (kind, start, end in code points, end
    exclusive; by start, then the order of the rules)."""
    kind = df.schema[id_col].dataType.simpleString()
    got = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        _scan(tuple(rules)), f"_id {kind}, spans {SPANS}")
    return got.select(F.col("_id").alias(id_col), "spans")


MASK = "[SECRET]"


def _redact(rules: tuple[Rule, ...], text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_at)
            for row, end, data, offsets in text_blocks(column):
                texts = column.slice(row, end - row).to_pylist()
                for i, spans in enumerate(scan_block(data, offsets, rules)):
                    if spans:
                        done, parts = 0, []
                        for _, a, b in spans:
                            if a >= done:
                                parts += [texts[i][done:a], MASK]
                            done = max(done, b)
                        texts[i] = "".join([*parts, texts[i][done:]])
                arrays = [pa.array(texts, column.type) if c == text_at else batch.column(c).slice(row, end - row)
                          for c in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(arrays, names)
    return run


def redact_secrets(df: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns, with every found span (overlapping ones as one) replaced by
    ``[SECRET]`` and ``chars_col`` recounted where a text changed."""
    names = [f"c{i}" for i in range(len(df.columns))]
    at = df.columns.index(text_col)
    plain = df.toDF(*names)
    got = plain.mapInArrow(_redact(tuple(rules), at, names), plain.schema).toDF(*df.columns)
    if chars_col in df.columns:
        got = got.withColumn(chars_col, F.when(F.contains(F.col(text_col), F.lit(MASK)), F.char_length(text_col).cast("long"))
                             .otherwise(F.col(chars_col)))
    return got


def op1(spark, sf_dir: str) -> DataFrame:
    got = find_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return got.select(
        "doc_id", *[count_kind(spans, k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(spans).alias("spans"))


def _either_case(pattern: str) -> str:
    """The same pattern with its letters outside of classes in either case, without a flag."""
    out, inside = [], False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            width = 4 if pattern[i + 1] == "x" else 2
            out.append(pattern[i:i + width])
            i += width
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(f"[{c.upper()}{c.lower()}]" if c.isalpha() and not inside else c)
        i += 1
    return "".join(out)


def _rule_sql(rank: int, rule: Rule) -> str:
    pattern = (_either_case(rule.pattern) if rule.ignore_case else rule.pattern).replace("'", "''")
    return f"""select rid, {rank} as rank, '{rule.kind}' as kind, upto - length(hit) as s, upto as e
  from (select rid, hit, cast(sum(length(piece) + length(hit)) over (partition by rid order by i) as bigint) as upto
        from (select rid, unnest(hits) as hit, unnest(pieces[1:len(hits)]) as piece, generate_subscripts(hits, 1) as i
              from (select rid, regexp_extract_all(text, '{pattern}') as hits, string_split_regex(text, '{pattern}') as pieces from d)
              where len(hits) > 0))
  where length(regexp_extract(hit, '{pattern}', {rule.group})) >= {rule.least}"""


SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
m as ({" union all ".join(_rule_sql(k, r) for k, r in enumerate(RULES))}),
g as (select rid, {", ".join(f"count_if(kind = '{k}') as n_{k}" for k in BASE_KINDS)},
        string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < {len(BASE_KINDS)}) as base,
        string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans
      from m group by rid)
select doc_id, {", ".join(f"cast(coalesce(n_{k}, 0) as bigint) as n_{k}" for k in BASE_KINDS)},
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (rid)
"""
