"""Byte-level BPE encoding and decoding as a monoid tree reduction.

Encoding.  A text is cut in halves down to leaves and neighbours are joined upwards.
* Documents: an element holds the pattern's matches of its text.  Two neighbours are joined by
  matching again a window around their boundary: it begins at the left's first match that could
  have looked past the boundary and grows to the right until a match ends where one of the
  right's matches ends; from there on both agree, because the pattern only looks forward.
* Matches: each is encoded on its own.  Long ones are halved; two token lists are joined by
  encoding the last and first k tokens around the boundary again, k growing until the pairs at
  both edges of the window are stable, that is, encode to themselves.  A token list whose
  neighbouring pairs are all stable is the encoding of its bytes, so nothing outside changes.
Decoding concatenates the byte strings of the ids up the same kind of tree.

Null and empty texts have no tokens.  Repeated rows are encoded row by row.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import common as C

#: Matches of the pattern look at most so many characters past their end or start.
LOOK = 3
#: Encoded matches that each Python worker keeps in each of two generations: when the younger is full it
#: becomes the older, whose entries come back on use.
KEPT = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder(dict):
    """A mapping of matches to packed ids (filled on demand) with the tree reductions on top."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = 1 << 14, leaf_bytes: int = 24):
        super().__init__()
        self.ranks, self.find = ranks, regex.compile(pattern)
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # -------------------------------------------------------------- one match
    def merge(self, data: bytes) -> list[int]:
        """Merge the neighbours of lowest rank until none is a token."""
        ranks, parts = self.ranks, [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        k = 1
        while True:
            head, tail = left[:-k], right[k:]
            window = self.merge(b"".join(self.tokens[i] for i in left[-k:] + right[:k]))
            if (not head or self.stable(head[-1], window[0])) and (not tail or self.stable(window[-1], tail[0])):
                return head + window + tail
            k *= 2

    def halves(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merge(data)
        mid = len(data) // 2
        return self.join(self.halves(data[:mid]), self.halves(data[mid:]))

    def __missing__(self, match: str) -> bytes:
        packed = self.older.get(match)
        if packed is None:
            data = match.encode()
            ids = [self.ranks[data]] if data in self.ranks else self.halves(data)
            packed = np.array(ids, "<u4").tobytes()
        if len(self) >= KEPT:
            self.older = dict(self)
            self.clear()
        self[match] = packed
        return packed

    # -------------------------------------------------------------- one text
    def split(self, text: str) -> list[str]:
        """The pattern's matches of the text."""
        if len(text) <= self.leaf_chars:
            return self.find.findall(text)
        mid = len(text) // 2
        return self.join_matches(self.split(text[:mid]), self.split(text[mid:]))

    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        back, chars = 0, 0  # matches of the left that may have looked past the boundary
        while back < len(left) and chars < LOOK:
            back += 1
            chars += len(left[-back])
        tail = "".join(left[len(left) - back:])
        k = 1
        while True:
            window = tail + "".join(right[:k])
            ends, at = {len(tail): 0}, len(tail)
            for i, m in enumerate(right[:k], 1):
                at += len(m)
                ends[at] = i
            whole = k >= len(right)
            again: list[str] = []
            for m in self.find.finditer(window):
                if not whole and m.end() > len(window) - LOOK:
                    break
                again.append(m[0])
                if m.end() in ends and m.end() >= len(tail):
                    return left[:len(left) - back] + again + right[ends[m.end()]:]
            if whole:
                return left[:len(left) - back] + again
            k *= 2

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: np.ndarray, leaf: int = 1 << 12) -> bytes:
        if len(ids) <= leaf:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


ENCODED = "doc_id long, n_tokens long, ids binary, decoded binary"
_ENCODERS: dict[tuple, Encoder] = {}  # of this Python worker, so that tasks share what was encoded


def _round_trip(sent, path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get((path, pattern))
        if encoder is None or encoder.ranks != sent.value:
            encoder = _ENCODERS[path, pattern] = Encoder(sent.value, pattern)
        for batch in C.slices(batches):
            ids = [encoder.encode(t) for t in C.utf8(C.column(batch, "text")).to_pylist()]
            decoded = [encoder.decode(np.frombuffer(i, "<u4")) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [C.column(batch, "doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])
    return run


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, ids, decoded): ids packed as little-endian unsigned
    32-bit integers, and the bytes they decode to.  The rank file is read once by the driver and
    broadcast (its size is that of the vocabulary)."""
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_round_trip(sent, ranks_path, pattern), ENCODED)
