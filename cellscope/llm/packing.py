"""Packing token sequences by Karmarkar-Karp multiway differencing.

Texts become ids of a byte-level BPE, each document ended by id 0. A document is cut into whole
windows and a rest, the rest into items of at most ``ITEM`` ids. Whole windows are sequences by
themselves. The items of a group (``GROUP`` at a time inside a Spark task, so memory is bounded
and nothing is shuffled) are dealt to k windows: every item starts as a partial partition of k
sums, and the two partitions with the largest spread are merged again and again, the largest
sum of one with the smallest of the other, which leaves near-equal windows. k starts at the
fewest windows that could hold the ids and rises whenever the fullest window exceeds the
capacity.

Sequence ids are (partition number << 33) + a counter, so they are unique without a shuffle and
equal when a task is run again on the same input.

Edge cases: a NULL or empty text is a document of id 0 alone; repeated rows and NULL ids are
packed as rows of their own; a very long text is tokenized in whole; an empty table gives no
pieces; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.llm.common import table
from cellscope.llm.shingles import text_blocks
from cellscope.llm.tokens import BlockTokenizer

WINDOW = 1024
ITEM = 256     # ids of an item at most; smaller items leave less padding and more cuts
GROUP = 1024   # items dealt at once
END_ID = 0


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items to k windows: the item numbers of each window."""
    if k == 1:
        return [list(range(len(sizes)))]
    # a partial partition: k (sum, items) by falling sum; only its non-zero sums are stored
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, [i])]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = _merge(a, b, k)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, tick, merged))
        tick += 1
    done = heap[0][2] if heap else []
    return [items for _, items in done] + [[] for _ in range(k - len(done))]


def _merge(a: list, b: list, k: int) -> list:
    """Largest sums of one with the smallest of the other; sums not stored are zero."""
    if len(a) < len(b):
        a, b = b, a
    free = k - len(a)
    out = list(a)
    # b's largest sums go to a's smallest: first to its zeros, then from its end upwards
    out += b[:free]
    for j, (s, items) in enumerate(b[free:]):
        t, own = a[len(a) - 1 - j]
        out[len(a) - 1 - j] = (t + s, own + items)
    out.sort(key=lambda x: -x[0])
    return out


def deal(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Items into near-equal windows of at most ``window``; the window count rises until they fit."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        dealt = differencing(sizes, k)
        if max((sum(sizes[i] for i in w) for w in dealt), default=0) <= window:
            return [w for w in dealt if w]
        k += max(1, k // 256)


BLOCK = 1 << 20          # bytes of text tokenized at once; arrays of sixty times as much stand beside them
PIECES = ("_id {}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def _pack(tokenizer_path: str, window: int, item: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = BlockTokenizer(tokenizer_path, added=True)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        waiting: list[tuple] = []  # (id, start, ids, doc_tokens) of items

        def emit(rows: list[tuple], kind) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        def flush() -> list[tuple]:
            nonlocal number, waiting
            rows = []
            for w in deal([len(x[2]) for x in waiting], window):
                at = 0
                for i in w:
                    key, start, ids, n = waiting[i]
                    rows.append((key, start, len(ids), ids.tobytes(), n, number, at))
                    at += len(ids)
                number += 1
            waiting = []
            return rows

        kind = None  # the Arrow type of the ids, known from the first batch
        for batch in batches:
            kind = batch.column(0).type
            for row, end, data, offsets in text_blocks(batch.column(1), BLOCK):
                keys = batch.column(0).slice(row, end - row).to_pylist()
                ids, ends = tokenizer.encode(data, offsets, END_ID)
                rows = []
                for i, key in enumerate(keys):
                    own = ids[ends[i]:ends[i + 1]]
                    whole = len(own) - len(own) % window
                    for a in range(0, whole, window):
                        rows.append((key, a, window, own[a:a + window].tobytes(), len(own), number, 0))
                        number += 1
                    for a in range(whole, len(own), item):
                        waiting.append((key, a, own[a:a + item].copy(), len(own)))
                        if len(waiting) >= group:
                            rows += flush()
                if rows:
                    yield emit(rows, kind)
        if waiting:
            yield emit(flush(), kind)
    return run


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, item: int = ITEM, group: int = GROUP) -> DataFrame:
    """Pieces: ``id_col``, start (ids of the document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset (in the sequence, gapless from 0).
    A sequence shorter than ``window`` is padded by its reader, unless its length is a power of two."""
    kind = df.schema[id_col].dataType.simpleString()
    got = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        _pack(tokenizer_path, window, item, group), PIECES.format(kind))
    return got.withColumnRenamed("_id", id_col)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op3(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), default_tokenizer()))
