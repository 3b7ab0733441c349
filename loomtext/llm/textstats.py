"""Whole-text statistics computed on Arrow buffers: word, symbol, line and repetition counts."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from loomtext.llm import common as C

SYMBOLS = b"#*$%&|<>"
SPACES = b"\t\n\v\f\r "


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SYMBOL, SPACE, UPPER = _table(SYMBOLS), _table(SPACES), _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT, PIPE, BANG, STOP = _table(b"0123456789"), _table(b"|"), _table(b"!?"), _table(b".,;:")
LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


class Counter:
    """Counts bytes of a class in each text of a string array."""

    def __init__(self, text: pa.Array):
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        self.data = data[offsets[0]:offsets[-1]]
        self.offsets = offsets - offsets[0]

    def __call__(self, kind: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(kind[self.data])
        return np.diff(np.searchsorted(at, self.offsets))

    def many(self, kind: np.ndarray) -> np.ndarray:
        """The same for classes with many members."""
        seen = np.concatenate([[0], np.cumsum(kind[self.data], dtype=np.int64)])
        return np.diff(seen[self.offsets])


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))


def repeated_words(codes: np.ndarray, lens: np.ndarray, window: int = 8) -> np.ndarray:
    """Words of each text that lie in a window of `window` words found twice or more in the text."""
    ends = np.cumsum(lens)
    per = np.maximum(lens - window + 1, 0)
    doc = np.repeat(np.arange(len(lens)), per)
    start = (ends - lens)[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    if not len(start):
        return np.zeros(len(lens), np.int64)
    odd = np.random.default_rng(8).integers(1, 1 << 62, window + 1, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        h = doc.astype(np.uint64) * odd[window]
        wide = codes.astype(np.uint64)
        for j in range(window):
            h += wide[start + j] * odd[j]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    a, b = start[order[1:][same]], start[order[:-1][same]]
    equal = doc[order[1:][same]] == doc[order[:-1][same]]
    for j in range(window):  # the words themselves decide
        equal &= codes[a + j] == codes[b + j]
    if not equal.all():  # hashes collided: number the windows exactly
        ids = np.unique(np.stack([doc, *(codes[start + j] for j in range(window))], 1), axis=0, return_inverse=True)[1].ravel()
        again = start[np.bincount(ids)[ids] > 1]
    else:
        again = np.concatenate([a, b])
    cover = np.zeros(int(ends[-1]) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return covered[ends] - covered[ends - lens]


def distinct_words(codes: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words, count of the most frequent word) of each text."""
    doc = np.repeat(np.arange(len(lens)), lens)
    pair = np.sort(doc.astype(np.int64) << 32 | codes.astype(np.int64))
    edge = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1], True]) if len(pair) else np.zeros(1, np.int64)
    owner, times = pair[edge[:-1]] >> 32, np.diff(edge)
    top = np.zeros(len(lens), np.int64)
    np.maximum.at(top, owner, times)
    return np.bincount(owner, minlength=len(lens)), top


def statistics(text: pa.Array) -> dict[str, np.ndarray]:
    """Counts of every text (nulls already replaced by empty texts)."""
    count = Counter(text)
    flat, lens = C.words(text)
    codes = flat.dictionary_encode().indices.to_numpy() if len(flat) else np.zeros(0, np.int32)
    raw = text.cast(pa.binary()).to_pylist()
    lines = np.array([duplicate_lines(t) for t in raw], np.int64).reshape(-1, 2)
    distinct, top = distinct_words(codes, lens)
    same = np.zeros(len(codes) + 1, np.int64)
    if len(codes):
        doc = np.repeat(np.arange(len(lens)), lens)
        same[1:-1] = np.cumsum((codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1]))
        same[-1] = same[-2]
    ends = np.cumsum(lens)
    return {"n_words": lens, "word_chars": count.many(LEAD) - count(SPACE), "n_symbols": count(SYMBOL),
            "n_lines": lines[:, 0], "n_dup_lines": lines[:, 1], "n_repeat_words": repeated_words(codes, lens),
            "n_distinct": distinct, "n_top": top, "n_upper": count(UPPER), "n_digits": count(DIGIT), "n_pipes": count(PIPE),
            "n_bangs": count(BANG), "n_stops": count(STOP),
            "n_adjacent": np.where(lens > 0, same[np.maximum(ends - 1, 0)] - same[np.maximum(ends - lens, 0)], 0) if len(codes) else np.zeros(len(lens), np.int64)}
