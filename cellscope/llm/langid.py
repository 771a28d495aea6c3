"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased and read as runs of letters, with the marks that follow a letter, each run
between two boundary signs. For each
language the 4-gram counts of its training texts give a model by interpolated Kneser-Ney
smoothing (absolute discounts, continuation counts below the highest order). The models of all
languages share sorted arrays of 64-bit n-gram keys: the key of an n-gram packs the low 16 bits
of its code points, so it is its own hash and only letters beyond the basic plane share one. Each
key has a row of log probabilities, one a language; a history has a row of log backoff weights.
A text goes to the language with the lowest cross-entropy per letter.

The score is calibrated: texts of a training fold that the models were not fitted on are put
into bins by the margin between the two lowest cross-entropies, and a bin's score is its share
of right answers, made monotone. ``rejected`` marks a score under ``MIN_SCORE``.

All training rows are counted, inside tasks and then by a grouped sum, and the models hold every
4-gram met, so discounts, totals and continuation counts come from whole counts. What is fitted
on the driver and sent to the tasks grows with the number of distinct 4-grams of the training
texts: a key and a number for each language.

Edge cases: a NULL text, or one without a letter, is ``und`` with score 0 and rejected; rows are
judged one by one; a training table without rows gives ``und`` everywhere; NULL languages are
not learned; only the id, text and (in training) language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscope.llm.common import table
from cellscope.llm.shingles import text_blocks

ORDER = 4
MIN_SCORE = 0.5
BINS, BIN_NATS = 200, 0.01   # margin bins of the calibration
UNKNOWN = "und"

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point 1 if it is a letter, 2 if it is a mark, else 0."""
    global _LETTERS
    if _LETTERS is None:
        import regex
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        found = np.zeros(0x110000, np.uint8)
        for kind, sign in ((1, r"\p{L}"), (2, r"\p{M}")):
            for m in regex.finditer(sign, points):
                found[ord(m[0])] = kind
        _LETTERS = found
    return _LETTERS


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a block (uint64: code points cut to 16 bits, at least 1; 0 at a boundary)
    and the row of each. One boundary follows each run of letters that does not end its text."""
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    # lower case by table, so that places stay
    points = _lower()[points]
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=at[1:])
    rows = at[offsets]
    kind = _letters()[points]
    letter = kind == 1
    marks = np.flatnonzero(kind == 2)
    if len(marks):
        # a mark belongs to the letter that it follows, in the same text, directly or after other marks
        carrier = np.maximum.accumulate(np.where(kind != 2, np.arange(len(points)), -1))[marks]
        start = rows[np.searchsorted(rows, marks, "right") - 1]
        letter[marks] = (carrier >= start) & (kind[carrier] == 1)
    prior = np.zeros(len(points), bool)
    prior[1:] = letter[:-1]
    prior[rows[:-1][rows[:-1] < len(points)]] = False
    # letters stay, and the first sign that ends a run
    keep = letter | (prior & ~letter)
    place = np.flatnonzero(keep)
    value = np.where(letter[place], np.maximum(points[place] & 0xFFFF, 1), 0).astype(np.uint64)
    return value, np.searchsorted(rows, place, "right") - 1


_LOWERED: np.ndarray | None = None


def _lower() -> np.ndarray:
    global _LOWERED
    if _LOWERED is None:
        out = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x10000):
            if not 0xD800 <= c < 0xE000:
                low = chr(c).lower()
                if len(low) == 1:
                    out[c] = ord(low)
        _LOWERED = out
    return _LOWERED


def grams(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram ending at each symbol, as a key, and its row. Symbols before a boundary, or
    before the start of the row, are read as boundaries."""
    if not len(value):
        return np.zeros(0, np.uint64), row
    key = value.copy()
    open_ = np.ones(len(value), bool)      # no boundary met so far, going back
    for back in range(1, ORDER):
        same = np.zeros(len(value), bool)
        same[back:] = row[back:] == row[:-back]
        earlier = np.zeros(len(value), np.uint64)
        earlier[back:] = value[:-back]
        open_ &= same & (earlier != 0)
        key |= np.where(open_, earlier, np.uint64(0)) << np.uint64(16 * back)
    return key, row


SCHEMA = "lang string, gram bigint, n bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, 4-gram) of a task, added up in the end of each few blocks."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        langs, keys, counts = [], [], []
        for lang, parts in held.items():
            key, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts.append(np.bincount(of, np.concatenate([p[1] for p in parts])).astype(np.int64))
            keys.append(key)
            langs += [lang] * len(key)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(keys).view(np.int64)),
                                           pa.array(np.concatenate(counts))], ["lang", "gram", "n"])
    for batch in batches:
        for row, end, data, offsets in text_blocks(batch.column(1)):
            lang = np.array(batch.column(0).slice(row, end - row).to_pylist(), object)
            key, of = grams(*symbols(data, offsets))
            for name in set(lang.tolist()):
                found, n = np.unique(key[(lang == name)[of]], return_counts=True)
                held.setdefault(name, []).append((found, n))
                size += len(found)
            if size > 2_000_000:
                yield out()
                held, size = {}, 0
    if size:
        yield out()


def count_grams(train: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) of all training rows."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    got = rows.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).mapInArrow(_count, SCHEMA)
    return got.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(counts: pd.DataFrame) -> dict:
    """The models from (lang, gram, n), as sorted key arrays and rows of log values."""
    langs = sorted(counts["lang"].unique())
    key = counts["gram"].to_numpy(np.int64).view(np.uint64)
    lang = np.searchsorted(np.array(langs, object), counts["lang"].to_numpy(object)) if len(counts) else np.zeros(0, int)
    n = counts["n"].to_numpy(float)
    mask = [np.uint64((1 << (16 * k)) - 1) for k in range(ORDER + 1 if ORDER < 4 else ORDER)]
    model = {"langs": langs, "prob": [], "keys": [], "back": [], "history": []}
    if not langs:
        return model
    # counts of each order: (key, lang) -> count; below the top, the number of distinct left neighbours
    levels = {ORDER: (key, lang, n)}
    for k in range(ORDER - 1, 0, -1):
        upper_key, upper_lang, _ = levels[k + 1]
        low = upper_key & mask[k]
        pair = pd.DataFrame({"k": low, "l": upper_lang}).groupby(["k", "l"], sort=True).size().reset_index(name="n")
        levels[k] = (pair["k"].to_numpy(np.uint64), pair["l"].to_numpy(), pair["n"].to_numpy(float))
    floor = np.log(1 / max(64, len(np.unique(levels[1][0]))))
    below_keys, below = np.zeros(0, np.uint64), None
    for k in range(1, ORDER + 1):
        kk, ll, nn = levels[k]
        ones, twos = (nn == 1).sum(), (nn == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        history = kk >> np.uint64(16)
        h_keys, h_of = np.unique(history, return_inverse=True)
        total = np.zeros((len(h_keys), len(langs)))
        kinds = np.zeros_like(total)
        np.add.at(total, (h_of, ll), nn)
        np.add.at(kinds, (h_of, ll), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(total > 0, discount * kinds / total, 1.0)  # weight left to the lower order
        keys, of = np.unique(kk, return_inverse=True)
        own = np.zeros((len(keys), len(langs)))
        np.add.at(own, (of, ll), nn - discount)
        hist_of_key = np.searchsorted(h_keys, keys >> np.uint64(16))
        own = np.where(total[hist_of_key] > 0, own / np.maximum(total[hist_of_key], 1e-300), 0)
        if k == 1:
            lower = np.full((len(keys), len(langs)), np.exp(floor))
        else:
            at = np.searchsorted(below_keys, keys & mask[k - 1])
            lower = np.exp(below[np.minimum(at, len(below_keys) - 1)])
        prob = np.log(own + back[hist_of_key] * lower)
        model["keys"].append(keys)
        model["prob"].append(prob)
        model["history"].append(h_keys)
        model["back"].append(np.log(back))
        below_keys, below = keys, prob
    model["floor"] = floor
    return model


def log_probs(model: dict, key: np.ndarray) -> np.ndarray:
    """Log probability of the last symbol of each 4-gram under each language: the value of the
    longest known n-gram, with the backoff weights of the longer known histories."""
    out = np.zeros((len(key), len(model["langs"])))
    left = np.arange(len(key))
    for k in range(ORDER, 0, -1):
        if not len(left):
            break
        now = key[left] if k == ORDER else key[left] & np.uint64((1 << (16 * k)) - 1)
        keys = model["keys"][k - 1]
        at = np.minimum(np.searchsorted(keys, now), len(keys) - 1)
        hit = keys[at] == now
        out[left[hit]] += model["prob"][k - 1][at[hit]]
        left, now = left[~hit], now[~hit]
        history = model["history"][k - 1]
        past = now >> np.uint64(16)
        at = np.minimum(np.searchsorted(history, past), len(history) - 1)
        known = history[at] == past
        out[left[known]] += model["back"][k - 1][at[known]]
    out[left] += model["floor"]
    return out


def entropies(model: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy (nats a symbol) of each row of a block under each language, and its symbols."""
    key, row = grams(*symbols(data, offsets))
    n = len(offsets) - 1
    sums = np.zeros((n, len(model["langs"])))
    # equal 4-grams of the block are looked up once
    distinct, of = np.unique(key, return_inverse=True)
    values = log_probs(model, distinct)
    for j in range(values.shape[1]):
        sums[:, j] = np.bincount(row, values[:, j][of], n)
    size = np.bincount(row, minlength=n)
    return -sums / np.maximum(size, 1)[:, None], size


def _predict(model, calibration):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        langs = np.array([*m["langs"], UNKNOWN], object)
        score = calibration
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column(1)):
                rest = [batch.column(0).slice(row, end - row)]
                if not m["langs"]:
                    best, margin = np.full(end - row, -1), np.zeros(end - row)
                else:
                    h, size = entropies(m, data, offsets)
                    order = np.argsort(h, axis=1, kind="stable")
                    best = order[:, 0]
                    two = np.take_along_axis(h, order[:, :2], 1)
                    margin = two[:, 1] - two[:, 0] if two.shape[1] > 1 else np.full(len(h), np.inf)
                    best = np.where(size > 0, best, -1)
                bins = np.minimum(BINS - 1, margin / BIN_NATS).astype(int)
                got = np.where(best >= 0, score[bins] if score is not None else 1.0, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(langs[best].tolist(), pa.string()), pa.array(got, pa.float64()), pa.array(bins, pa.int32())],
                    ["_id", "lang_pred", "score", "bin"])
    return run


def predict(df: DataFrame, model, calibration: np.ndarray | None, id_col: str, text_col: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    got = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        _predict(model, calibration), f"_id {kind}, lang_pred string, score double, bin int")
    return got.withColumnRenamed("_id", id_col)


def calibrate(right: dict[int, tuple[int, int]]) -> np.ndarray:
    """A score for each margin bin from (rows, right answers): shares with one wrong and one
    right answer added, pooled until they rise with the margin."""
    groups: list[list[float]] = []  # [sum of right, rows, bins]
    for b in range(BINS):
        n, ok = right.get(b, (0, 0))
        groups.append([ok + 0.5 / BINS, n + 1 / BINS, 1])
        while len(groups) > 1 and groups[-2][0] * groups[-1][1] >= groups[-1][0] * groups[-2][1]:
            ok2, n2, k2 = groups.pop()
            groups[-1] = [groups[-1][0] + ok2, groups[-1][1] + n2, groups[-1][2] + k2]
    return np.concatenate([np.full(int(k), min(1.0, ok / n)) for ok, n, k in groups])


def identify(df: DataFrame, train: DataFrame, check: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Models from ``train``, calibration on ``check`` (labelled rows outside ``train``), and one
    row per row of ``df``: id, lang_pred, score, rejected."""
    counts = count_grams(train, text_col, lang_col)
    # Arrow, with each language's name kept once
    whole = counts.select("lang", "gram", "n").toArrow()
    whole = whole.set_column(0, "lang", whole["lang"].dictionary_encode())
    model = df.sparkSession.sparkContext.broadcast(fit(whole.to_pandas()))
    known = check.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    key = F.struct(F.col(lang_col).alias("l")).alias("_key")
    tried = predict(known.select(key, F.col(text_col).alias("_t")), model, None, "_key", "_t")
    bins = tried.where(F.col("lang_pred") != UNKNOWN).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("lang_pred") == F.col("_key.l")).cast("int")).alias("ok")).collect()
    got = predict(df, model, calibrate({r["bin"]: (r["n"], r["ok"]) for r in bins}), id_col, text_col)
    return got.select(id_col, "lang_pred", "score", (F.col("score") < MIN_SCORE).alias("rejected"))


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a NULL id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % n, F.lit(-1).cast("long"))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = fold(F.col("doc_id"), 4)
    known = docs.select("doc_id", "text", "lang")
    got = identify(docs, known.where(part.isin(0, 1)), known.where(part == 3))
    return got.select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score", "rejected")
