"""Byte-level BPE over blocks of texts.

A text's pre-tokens are found for a whole block at once with numpy (the published pattern of
byte-level BPE: contractions, letters, digits, other marks, each with one leading space, and
white space), equal ones are hashed together, and each distinct pre-token of the block is
merged once; ids are then laid out by gathering. The ids are those that ``tokenizers`` gives
for the whole text; the tests compare them. The file's added tokens are read as such where
``added`` is set, else as ordinary text. The
merges run in tiktoken over the same vocabulary, because a call of ``tokenizers`` costs about
ten times as much as the merges of one short word.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from cellscope.llm.shingles import mix

_SPACE, _LETTER, _NUMBER, _OTHER = 1, 2, 3, 4
_CLASSES: np.ndarray | None = None
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _classes() -> np.ndarray:
    """The class of each code point, from the tables of the regex module."""
    global _CLASSES
    if _CLASSES is None:
        import regex
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, points):
                a, b = ord(m[0][0]), ord(m[0][-1])
                if b - a == len(m[0]) - 1:
                    table[a:b + 1] = kind
                else:
                    for c in m[0]:
                        table[ord(c)] = kind
        _CLASSES = table
    return _CLASSES


def pretoken_starts(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points of a block; ``rows`` are the offsets of its texts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)        # a text starts here (or the block ends)
    first[rows] = True
    before = np.empty(n, np.uint8)       # class of the character before, 0 at the start of a text
    before[0] = 0
    before[1:] = kind[:-1]
    before[first[:n]] = 0
    start = kind != before
    space = points == 32
    after = np.zeros(n, np.uint8)        # class of the character after, 0 at the end of a text
    after[:-1] = kind[1:]
    after[first[1:]] = 0
    is_space = kind == _SPACE
    # the last white space before something else stands apart from those before it ...
    last = is_space & (after != _SPACE) & (after != 0)
    start |= last
    # ... and, if it is a plain space, belongs to what follows
    joined = last & space
    start[1:] &= ~joined[:-1]
    # contractions: an apostrophe that starts a pre-token takes its letters with it
    tick = np.flatnonzero((points == 39) & start)
    if len(tick):
        after_of = lambda k: points[np.minimum(tick + k, n - 1)]
        inside = lambda k: (tick + k < n) & ~_crosses(first, tick, k, n)
        a, b = np.where(inside(1), after_of(1), 0), np.where(inside(2), after_of(2), 0)
        one = np.isin(a, [115, 116, 109, 100])                                        # 's 't 'm 'd
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))  # 're 've 'll
        for where, size in ((tick[one], 2), (tick[two & ~one], 3)):
            for k in range(1, size):
                start[where + k] = False
            ends = where + size
            ends = ends[ends < n]
            ends = ends[~first[ends]]
            # what follows starts a pre-token, unless it is a run of marks' inside (never: letters precede)
            start[ends] = True
    start |= first[:n]
    return np.flatnonzero(start)


def _crosses(first: np.ndarray, at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Whether a text starts within the k characters after ``at``."""
    out = np.zeros(len(at), bool)
    for j in range(1, k + 1):
        out |= first[np.minimum(at + j, n)]
    return out


def _byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable Latin-1 marks
    stand for themselves, the other bytes, in order, for the code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Splits nothing here, since only single pre-tokens are encoded.
_WHOLE = r"(?s).+"


class BlockTokenizer:
    """Encodes blocks of texts with the vocabulary of a ``tokenizers`` JSON file."""

    def __init__(self, path: str, added: bool = False):
        import json

        import tiktoken
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        special = {t["content"] for t in described["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in described["added_tokens"]} if added else {}
        byte = _byte_symbols()
        ranks = {bytes(byte[c] for c in t): i for t, i in described["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("block", pat_str=_WHOLE, mergeable_ranks=ranks, special_tokens={})
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _scale(self, n: int) -> None:
        if len(self.powers) <= n:
            def run(base):
                p = np.full(n + 1, base, np.uint64)
                p[0] = 1
                return np.multiply.accumulate(p)
            self.powers, self.inverse = run(_BASE), run(_INVERSE)

    def _added_at(self, text: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end places of the added tokens in a block; of overlapping ones, the first and longest."""
        if not any(t in text for t in self.added):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, free = [], 0
        any_of = "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
        for m in re.finditer(f"(?=({any_of}))", text):
            a, b = m.span(1)
            if a >= free and np.searchsorted(rows, a, "right") == np.searchsorted(rows, b - 1, "right"):
                found.append((a, b))
                free = b
        at = np.array(found, np.int64).reshape(-1, 2)
        return at[:, 0], at[:, 1]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of the texts of a block, ``end_id`` after each, and their offsets."""
        text = data.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        at = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=at[1:])
        rows = at[offsets]
        # an added token parts its text
        a, b = self._added_at(text, rows)
        starts = pretoken_starts(points, np.concatenate([rows, a, b]))
        if len(a):
            of = np.searchsorted(a, starts, "right") - 1
            starts = starts[(of < 0) | (starts == a[of]) | (starts >= b[of])]
        ends = np.append(starts[1:], len(points))
        n = len(points)
        self._scale(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        distinct, where, of = np.unique(keys, return_index=True, return_inverse=True)
        encode = self.encoding.encode_ordinary
        parts = [text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        lists = [[self.added[x]] if x in self.added else encode(x) for x in parts]
        lists.append([end_id])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        begins = np.cumsum(sizes) - sizes
        # the end id of a row comes after the last of its pre-tokens
        cut = np.searchsorted(starts, rows[1:])
        order = np.insert(of, cut, len(lists) - 1)
        size = sizes[order]
        total = np.cumsum(size)
        ids = flat[np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - size - begins[order], size)]
        last = cut + np.arange(len(cut))
        return ids, np.concatenate([[0], total[last]]) if len(cut) else np.zeros(1, np.int64)
