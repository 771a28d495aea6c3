"""Fill-in-the-middle transformation with memoized content-defined chunks.

A text is a sequence of lines (each with its line feed); two cuts at line ends make prefix, middle
and suffix, which are written in the order prefix, suffix, middle (``psm``) or suffix, prefix,
middle (``spm``), each after its marker. A text that is empty, holds a marker or is not chosen
stays as it is (``plain``).

Cuts are found by chunks. A rolling hash over the last ``WINDOW`` bytes ends a chunk wherever its
low bits are zero, so chunks depend on content alone, and passages that documents share fall into
the same chunks wherever they stand. Each task keeps a cache from chunk to boundary summary (its
line ends and its code points); the chunk's bytes are the key, so a shared chunk is verified byte by
byte before its summary is used. Sums of the chunks' counts tell in which chunk the wanted line
ends, and the summary tells where in it. The cache holds ``CACHE_BYTES`` at most and starts anew
when full; it spares work and never changes a result.

The draws come from a digest of seed and id: its first four groups of eight digits give both cuts,
whether a text is chosen and its form. They and the way back (``restore``) are SQL expressions.

Edge cases: a NULL text counts as empty, a NULL id as an empty one in the digest; repeated rows
give repeated results; a line may be as long as the text; an empty table gives an empty result;
other columns are not read by ``fill_in_middle`` and kept as they are by ``transform_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscope.llm.common import table
from cellscope.llm.shingles import text_blocks

SEED = 7
FIM_PERCENT = 100
SPM_PERCENT = 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))

WINDOW = 16                  # bytes that the rolling hash sees, a power of two
CHUNK_BITS = 10              # a chunk ends once in 2^CHUNK_BITS bytes
MAX_CHUNK = 1 << 14          # and after so many bytes at the latest
CACHE_BYTES = 32 << 20

_BYTE = np.random.default_rng(20240311).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The places in a block of texts after which a chunk ends, without the ends of the texts.

    The hash of a byte is the sum of the values of the last WINDOW bytes, each shifted by two bits
    for every byte since; it is built by doubling the window."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    h = _BYTE[data]
    width = 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(2 * width)
        h, width = wider, 2 * width
    ends = np.flatnonzero((h >> np.uint32(32 - CHUNK_BITS)) == 0) + 1
    # a window that reaches into the text before says nothing about this text
    start = offsets[np.searchsorted(offsets, ends, "left") - 1]
    return ends[ends - start >= WINDOW]


class ChunkCache:
    """chunk -> (line ends counted from its start, code points)."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.size, self.held = limit, 0, {}
        self.hits = self.misses = 0

    def summary(self, chunk: bytes) -> tuple[np.ndarray, int]:
        got = self.held.get(chunk)
        if got is not None:
            self.hits += 1
            return got
        self.misses += 1
        b = np.frombuffer(chunk, np.uint8)
        got = (np.flatnonzero(b == 10) + 1, int(np.count_nonzero((b & 0xC0) != 0x80)))
        if self.size + len(chunk) > self.limit:
            self.held, self.size = {}, 0
        self.held[chunk] = got
        self.size += len(chunk)
        return got


def summaries(text: bytes, ends: np.ndarray, cache: ChunkCache) -> Iterator[tuple[int, np.ndarray, int]]:
    """(start, line ends in the chunk, code points) of each chunk; ``ends`` are the places of
    ``chunk_ends`` in this text."""
    start = 0
    for end in [*ends.tolist(), len(text)]:
        while start < end:
            stop = min(end, start + MAX_CHUNK)
            yield start, *cache.summary(text[start:stop])
            start = stop


class Cuts:
    """The lines of one text, by the summaries of its chunks."""

    def __init__(self, text: bytes, ends: np.ndarray, cache: ChunkCache):
        self.text = text
        self.starts, self.lines, self.chars = [], [], []
        for start, lines, chars in summaries(text, ends, cache):
            self.starts.append(start)
            self.lines.append(lines)
            self.chars.append(chars)
        # feeds and code points up to and with each chunk
        self.feeds = np.cumsum([len(x) for x in self.lines], dtype=np.int64)
        self.points = np.cumsum(self.chars, dtype=np.int64)
        feeds = int(self.feeds[-1]) if len(self.feeds) else 0
        self.n = feeds + (len(text) > 0 and text[-1] != 10)

    def after(self, line: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``line`` lines."""
        if line <= 0:
            return 0, 0
        if line >= self.n:
            return len(self.text), int(self.points[-1])
        c = int(np.searchsorted(self.feeds, line))
        start = self.starts[c]
        nth = line - (int(self.feeds[c]) - len(self.lines[c]))
        place = start + int(self.lines[c][nth - 1])
        inside = np.frombuffer(self.text, np.uint8, place - start, start)
        return place, int(self.points[c]) - self.chars[c] + int(np.count_nonzero((inside & 0xC0) != 0x80))


def rearranged(prefix: bytes, middle: bytes, suffix: bytes, spm: bool) -> bytes:
    p, s, m = MARKERS
    return s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle


def _transform(names: list[str], fim_percent: int, spm_percent: int):
    """Batches of the columns ``names``, text and four draws -> ``names`` and the results."""
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache()
        for batch in batches:
            h = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(k + 1, k + 5)]
            for row, end, data, offsets in text_blocks(batch.column(k)):
                n, form, out, before, between = [], [], [], [], []
                ends = chunk_ends(data, offsets)
                bounds = np.searchsorted(ends, offsets)
                for i in range(end - row):
                    a = int(offsets[i])
                    text = data[a:offsets[i + 1]].tobytes()
                    cuts = Cuts(text, ends[bounds[i]:bounds[i + 1]] - a, cache)
                    n.append(cuts.n)
                    h1, h2, h3, h4 = (int(x[row + i]) for x in h)
                    if not text or h3 % 100 >= fim_percent or any(m in text for m in MARKERS):
                        form.append("plain")
                        out.append(text)
                        before.append(None)
                        between.append(None)
                        continue
                    first, last = sorted((h1 % (cuts.n + 1), h2 % (cuts.n + 1)))
                    (b1, c1), (b2, c2) = cuts.after(first), cuts.after(last)
                    spm = h4 % 100 < spm_percent
                    form.append("spm" if spm else "psm")
                    out.append(rearranged(text[:b1], text[b1:b2], text[b2:], spm))
                    before.append(c1)
                    between.append(c2 - c1)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(row, end - row) for c in range(k)], pa.array(n, pa.int64()), pa.array(form, pa.string()),
                     pa.array(out, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64())],
                    [*names, "n", "form", "output", "prefix_chars", "middle_chars"])
    return run


def draws(id_col: Column, seed: int) -> list[Column]:
    """The first four groups of eight hex digits of the digest of seed and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _transformed(df: DataFrame, keep: list[str], id_col: str, text_col: str, seed: int, fim_percent: int, spm_percent: int) -> DataFrame:
    """The columns ``keep`` as c0, c1, ... and the results."""
    names = [f"c{i}" for i in range(len(keep))]
    x = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).alias("_text"),
                  *[d.alias(f"_h{i}") for i, d in enumerate(draws(F.col(id_col), seed))])
    kinds = [f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True)]
    return x.mapInArrow(_transform(names, fim_percent, spm_percent), ", ".join(
        [*kinds, "n bigint, form string, output string, prefix_chars bigint, middle_chars bigint"]))


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per input row: ``id_col``, n (lines), form, output (the text to train on),
    prefix_chars, middle_chars (code points; NULL if plain)."""
    return _transformed(df, [id_col], id_col, text_col, seed, fim_percent, spm_percent).withColumnRenamed("c0", id_col)


def transform_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", seed: int = SEED,
                        fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """All rows and columns, with the text replaced by its transformed one and ``chars_col``
    recounted."""
    got = _transformed(df, df.columns, id_col, text_col, seed, fim_percent, spm_percent)
    new = {text_col: F.col("output"), chars_col: F.char_length("output").cast("long")}
    return got.select(*[new.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(df.columns)])


def restore(output: Column, form: Column) -> Column:
    """The text from its output and form. No part holds a marker, so the parts lie between them."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def op11(spark, sf_dir: str) -> DataFrame:
    got = fill_in_middle(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = f"""
with d as (select doc_id, coalesce(text, '') as text, sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') as units,
             {", ".join(f"cast('0x' || substr(h, {8 * i + 1}, 8) as bigint) as h{i + 1}" for i in range(4))} from d),
c as (select *, len(units) as n,
             case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}')
                       or h3 % 100 >= {FIM_PERCENT} then 'plain' when h4 % 100 < {SPM_PERCENT} then 'spm' else 'psm' end as form,
             least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b from u),
p as (select *, array_to_string(units[1:a], '') as pre, array_to_string(units[a + 1:b], '') as mid, array_to_string(units[b + 1:n], '') as suf
      from c)
select doc_id, cast(n as bigint) as n, form,
       case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
       sha256(case form when 'plain' then text when 'spm' then '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid
              else '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""
