"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's chance of being toxic is logistic in the hashed
words it holds, and a document is toxic unless all of its sentences are clean (noisy-or), so
sentence weights are learned from document labels alone and the sentences that carry a
document's score can be pointed at.

The fit uses at most ``MAX_TRAIN`` labelled documents of each class, taken in the order of a
digest of their text (``op10``: of their id), and all their sentences; this bound is the only one.
A first pass over them counts documents by word and label and so finds the words that go with the
label; a second one brings each document's distinct sets of such words, one a sentence, with their
counts. Scoring reads every sentence of every text.

Edge cases: a NULL or empty text, or one without words, has no sentences and scores 0; rows are
judged one by one; without labels of both classes every score is 0; NULL labels are not learned;
repeated labels of an id count once if they agree, and the largest counts if not; only the id
and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.llm.common import table
from cellscope.llm.langid import fold
from cellscope.llm.shingles import text_blocks, word_bounds, word_hashes

BITS = 18                    # hashed words
MAX_TRAIN = 4000             # labelled documents of each class
THRESHOLD = 0.7
OFFENDING = 0.5              # a sentence from this chance on is pointed at
MIN_DOCS, MIN_Z = 3, 2.5
ROUNDS = 150
DECAY = 1e-4

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True
_INSIDE = np.zeros(256, bool)    # bytes of words: ASCII letters and digits, and all beyond ASCII
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def sentences(data: np.ndarray, offsets: np.ndarray):
    """Words of a block as (hashed word, sentence of each word), and for each sentence its row
    and its first and last byte. Only sentences with a word are kept."""
    starts, ends, _ = word_bounds(data, offsets, ~_INSIDE)
    word = (word_hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    stops = np.unique(np.concatenate([np.flatnonzero(_END[data]) + 1, offsets[1:]]))
    of = np.searchsorted(stops, starts, "right")
    kept, of = np.unique(of, return_inverse=True)
    end = stops[kept]
    begin = np.where(kept > 0, stops[np.maximum(kept - 1, 0)], 0)
    row = np.searchsorted(offsets, begin, "right") - 1
    return word, of, row, begin, end


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each task, the number of its documents with each word, by label; words of -1 count the
    documents themselves."""
    held = np.zeros((2, (1 << BITS) + 1), np.int64)
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        for row, end, data, offsets in text_blocks(batch.column(1)):
            word, of, owner, _, _ = sentences(data, offsets)
            pair = np.unique(owner[of] * (1 << BITS) + word)
            own = labels[row:end].astype(int)
            np.add.at(held, (own[pair >> BITS], pair & ((1 << BITS) - 1)), 1)
            held[:, -1] += np.bincount(own, minlength=2)
    label, word = np.nonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(np.where(word == 1 << BITS, -1, word), pa.int32()),
                                      pa.array(held[label, word])], ["label", "word", "n"])


def _features(kept):
    """Each document's distinct sets of kept words, one a sentence, and how often each occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column(1)):
                word, of, owner, _, _ = sentences(data, offsets)
                told = kept.value[word]
                pair = np.unique(of[told] * (1 << BITS) + word[told])
                cut = np.searchsorted(pair >> BITS, np.arange(len(owner) + 1))
                words = pair & ((1 << BITS) - 1)
                bags: list[dict[tuple, int]] = [{} for _ in range(end - row)]
                for s, r in enumerate(owner.tolist()):
                    key = tuple(words[cut[s]:cut[s + 1]].tolist())
                    bags[r][key] = bags[r].get(key, 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array([list(map(list, b)) for b in bags], pa.list_(pa.list_(pa.int32()))),
                     pa.array([list(b.values()) for b in bags], pa.list_(pa.int64()))], ["label", "bag", "times"])
    return run


def associated(a: np.ndarray, b: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """The words whose presence goes with the label, from the toxic and the clean documents that
    hold each: log odds ratio ``MIN_Z`` standard errors from zero, in ``MIN_DOCS`` training
    documents at least. Words of a few documents would only let the fit learn those by heart."""
    cells = [a + 0.5, pos - a + 0.5, b + 0.5, neg - b + 0.5]
    ratio = np.log(cells[0] * cells[3] / (cells[1] * cells[2]))
    return (a + b >= MIN_DOCS) & (np.abs(ratio) >= MIN_Z * np.sqrt(sum(1 / c for c in cells)))


def fit(bags: list[list[list[int]]], labels: np.ndarray, times: list[list[int]] | None = None) -> tuple[np.ndarray, float]:
    """Word weights and the bias, by gradient steps (Adam) on the noisy-or log loss, classes
    weighed equally. A bag holds the word sets of its sentences; ``times`` says how many sentences
    have each (one if not given)."""
    weight, bias = np.zeros(1 << BITS), -4.0
    if not len(labels) or labels.min() == labels.max():
        return weight, -np.inf
    sizes = [[len(s) for s in bag] for bag in bags]
    word = np.array([w for bag in bags for s in bag for w in s], np.int64)
    of = np.repeat(np.arange(sum(map(len, sizes))), [n for bag in sizes for n in bag])
    doc = np.repeat(np.arange(len(bags)), [len(bag) for bag in sizes])
    n_same = np.ones(len(doc)) if times is None else np.array([n for bag in times for n in bag], float)
    y = labels.astype(float)
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    active, place = np.unique(word, return_inverse=True)
    w = np.zeros(len(active))
    n_sets = len(doc)
    m = np.zeros(len(active) + 1)
    v = np.zeros(len(active) + 1)
    for t in range(1, ROUNDS + 1):
        z = bias + np.bincount(of, w[place], n_sets)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = np.bincount(doc, n_same * np.log1p(-np.minimum(p, 1 - 1e-9)), len(bags))
        toxic = -np.expm1(log_clean)
        pull = np.where(y == 1, -np.exp(log_clean) / np.maximum(toxic, 1e-6), 1.0) * share
        g_set = pull[doc] * p * n_same
        g = np.append(np.bincount(place, g_set[of], len(active)) / len(bags) + DECAY * w, g_set.sum() / len(bags))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    weight[active] = w
    return weight, float(bias)


def sample(labelled: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(label, text) of at most ``MAX_TRAIN`` labelled rows of each class."""
    rows = labelled.where(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull()) \
        .select(F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("rank"))
    part = [rows.where(F.col("label") == k).orderBy("rank").limit(MAX_TRAIN) for k in (0, 1)]
    return part[0].unionByName(part[1]).select("label", "text")


def train(spark, labelled: DataFrame, text_col: str, label_col: str) -> tuple[np.ndarray, float]:
    """Weights from a bounded sample of labelled rows."""
    rows = sample(labelled, text_col, label_col)
    seen = rows.mapInArrow(_words, "label int, word int, n bigint").groupBy("label", "word").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros((2, (1 << BITS) + 1))
    held[seen["label"].to_numpy(int), seen["word"].to_numpy(int)] = seen["n"].to_numpy(float)
    kept = spark.sparkContext.broadcast(associated(held[1, :-1], held[0, :-1], held[1, -1], held[0, -1]))
    got = rows.mapInArrow(_features(kept), "label int, bag array<array<int>>, times array<bigint>").toPandas()
    return fit([[list(s) for s in bag] for bag in got["bag"]], got["label"].to_numpy(int), got["times"].tolist())


SPANS = "array<struct<start:bigint,end:bigint,chance:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = model.value
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column(1)):
                n = end - row
                word, of, owner, begin, stop = sentences(data, offsets)
                # a word counts once in a sentence
                pair = np.unique(of * (1 << BITS) + word)
                z = bias + np.bincount(pair >> BITS, weight[pair & ((1 << BITS) - 1)], len(owner))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                p[z == -np.inf] = 0
                score = -np.expm1(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), n))
                spans: list[list[dict]] = [[] for _ in range(n)]
                hot = np.flatnonzero(p >= OFFENDING)
                if len(hot):
                    at = np.zeros(len(data) + 1, np.int64)
                    np.cumsum((data & 0xC0) != 0x80, out=at[1:])
                    for s in hot.tolist():
                        r = int(owner[s])
                        zero = at[offsets[r]]
                        spans[r].append({"start": int(at[begin[s]] - zero), "end": int(at[stop[s]] - zero), "chance": float(p[s])})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(score), pa.array(spans, _SPANS)],
                                                 ["_id", "score", "sentences"])
    return run


def score(df: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, and the offending sentences (start, end in code points,
    chance). The model's size is fixed by ``BITS``."""
    kind = df.schema[id_col].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    got = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        _score(sent), f"_id {kind}, score double, sentences {SPANS}")
    return got.withColumnRenamed("_id", id_col)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held = fold(F.col("doc_id"), 3) == 1
    labelled = labels.where(fold(F.col("doc_id"), 3).isin(0, 2))
    # the sample is drawn by id before its texts are fetched, so only its rows are joined
    order = F.xxhash64(F.col("doc_id"), F.lit(1))
    chosen = None
    for k in (0, 1):
        some = labelled.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(MAX_TRAIN)
        chosen = some if chosen is None else chosen.unionByName(some)
    model = train(spark, docs.join(F.broadcast(chosen), "doc_id"), "text", "toxic")
    got = score(docs, model)
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                      F.array_join(F.transform("sentences", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("offending"))
