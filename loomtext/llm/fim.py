"""Fill-in-the-middle by content-defined chunk memoization.

Texts are cut into chunks where a rolling hash of the last 32 bytes hits a fixed pattern, so equal
passages give equal chunks wherever they stand.  A chunk's summary holds what a document needs of it:
its code points, the word ends inside, whether it begins or ends with white space, its first and last
two bytes and whether it holds a marker.  Summaries form a monoid; a document's is the join of its
chunks', and a word end or marker across a boundary is found by the join.  Each Python worker keeps
summaries by the chunk's hash and compares the chunk's bytes before it uses one.

Tokens are words with the white space before them, and white space at the end of a text; a text that
is not empty has one token more than it has word ends followed by white space.  The document's cuts
come from its id alone; the running counts of the chunks tell in which chunk a cut lies, and only that
chunk is looked into.

Null texts are empty; empty texts and texts with a marker stay plain, white space alone is one token.
A null doc_id counts as the empty string.  Repeated rows are transformed row by row, to the same result.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm import common as C

MARKERS = (b"<P>", b"<S>", b"<M>")
#: Bytes under the rolling hash, and of the shortest and longest chunk; cuts come every 2^10 bytes or so.
WINDOW, LEAST, MOST, BITS = 32, 256, 8192, 10
#: Bytes of chunks that each Python worker keeps in each of two generations.
KEPT = 8 << 20

GEAR = np.random.default_rng(13).integers(0, 1 << 32, 256, np.uint32)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


class Summary(NamedTuple):
    chars: int
    ends: int
    begins_space: bool
    ends_space: bool
    marked: bool
    head: bytes
    tail: bytes

    def join(self, other: "Summary") -> "Summary":
        """The summary of two neighbours taken together."""
        edge = self.tail + other.head
        return Summary(self.chars + other.chars, self.ends + other.ends + (not self.ends_space and other.begins_space),
                       self.begins_space, other.ends_space, self.marked or other.marked or any(m in edge for m in MARKERS),
                       (self.head + other.head)[:2], (self.tail + other.tail)[-2:])


def word_ends(chunk: bytes) -> np.ndarray:
    """Places inside the chunk where a word has ended and white space begins."""
    space = SPACE[np.frombuffer(chunk, np.uint8)]
    return np.flatnonzero(~space[:-1] & space[1:]) + 1


def summarise(chunk: bytes) -> Summary:
    data = np.frombuffer(chunk, np.uint8)
    return Summary(int(LEAD[data].sum()), len(word_ends(chunk)), bool(SPACE[data[0]]), bool(SPACE[data[-1]]),
                   any(m in chunk for m in MARKERS), chunk[:2], chunk[-2:])


class Cache:
    """Summaries by hash, checked by content; when the younger generation is full it becomes the older."""

    def __init__(self, limit: int = KEPT):
        self.limit, self.size, self.young, self.old = limit, 0, {}, {}
        self.hits = self.misses = 0

    def __call__(self, chunk: bytes) -> Summary:
        key = xxhash.xxh3_64_intdigest(chunk)
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self._keep(key, found)
        if found is not None and found[0] == chunk:
            self.hits += 1
            return found[1]
        self.misses += 1
        summary = summarise(chunk)
        self._keep(key, (chunk, summary))
        return summary

    def _keep(self, key: int, entry: tuple[bytes, Summary]) -> None:
        if self.size >= self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = entry
        self.size += len(entry[0]) + 200


def candidates(data: np.ndarray) -> list[int]:
    """Places behind which the rolling hash of the last WINDOW bytes hits the pattern."""
    h = GEAR[data]
    for w in (1, 2, 4, 8, 16):  # sums of 2, 4, ... 32 bytes, each shifted by its distance
        further = h.copy()
        further[w:] += h[:-w] << np.uint32(w)
        h = further
    return (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist()


def chunk_ends(begin: int, end: int, hits: list[int]) -> list[int]:
    """Ends of the chunks of the text at [begin, end): the first hit that leaves LEAST bytes or more
    (so the window lies inside the chunk), after MOST bytes the longest chunk."""
    out = []
    while end - begin > LEAST:
        i = bisect_left(hits, begin + LEAST)
        cut = min(hits[i] if i < len(hits) else end, begin + MOST)
        if cut >= end:
            break
        out.append(cut)
        begin = cut
    return [*out, end] if end > begin else out


class Cut(NamedTuple):
    place: int  # in bytes
    chars: int


def locate(data: bytes, ends: list[int], summaries: list[Summary], wanted: list[int], n: int) -> list[Cut]:
    """Where the first `wanted` (rising) tokens of a text end: running counts choose the chunk."""
    out, begin, chars, seen, before, todo = [], ends[0] - len(data[:ends[0]]), 0, 0, None, list(wanted)
    total = sum(s.chars for s in summaries)
    for end, s in zip(ends, summaries):
        edge = before is not None and not before.ends_space and s.begins_space
        inside = None
        while todo and todo[0] < n and todo[0] <= seen + edge + s.ends:
            k = todo.pop(0)
            if k == 0 or (edge and k == seen + 1):
                out.append(Cut(begin if k else 0, chars if k else 0))
                continue
            chunk = data[begin:end]
            inside = word_ends(chunk) if inside is None else inside
            at = int(inside[k - seen - edge - 1])
            out.append(Cut(begin + at, chars + int(LEAD[np.frombuffer(chunk[:at], np.uint8)].sum())))
        seen, before, begin, chars = seen + edge + s.ends, s, end, chars + s.chars
    return out + [Cut(len(data), total) for _ in todo]


class Plan(NamedTuple):
    """How an id decides: seed, percentage of transformed documents, percentage of those with the suffix first."""

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80

    def draws(self, doc_id) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def transform_text(data: bytes, hits: list[int], begin: int, doc_id, plan: Plan, cache) -> tuple[int, str, bytes, int | None, int | None]:
    """(n, form, output, prefix_chars, middle_chars) of one text, which stands at `begin` of the bytes with `hits`."""
    ends = [e - begin for e in chunk_ends(begin, begin + len(data), hits)]
    summaries = [cache(data[a:b]) for a, b in zip([0, *ends], ends)]
    whole = None
    for s in summaries:
        whole = s if whole is None else whole.join(s)
    n = whole.ends + 1 if whole else 0
    h = plan.draws(doc_id)
    if whole is None or whole.marked or h[2] % 100 >= plan.rate:
        return n, "plain", data, None, None
    first, second = locate(data, ends, summaries, sorted((h[0] % (n + 1), h[1] % (n + 1))), n)
    prefix, middle, suffix = data[:first.place], data[first.place:second.place], data[second.place:]
    spm = h[3] % 100 < plan.suffix_first
    parts = (b"<S>", suffix, b"<P>", prefix, b"<M>", middle) if spm else (b"<P>", prefix, b"<S>", suffix, b"<M>", middle)
    return n, "spm" if spm else "psm", b"".join(parts), first.chars, second.chars - first.chars


OUT = "doc_id long, n long, form string, output string, prefix_chars long, middle_chars long"
_CACHE = Cache()  # of this Python worker, so that tasks share what was summarised


def _transform(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            text = C.utf8(C.column(batch, "text"))
            offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
            offsets, raw = (offsets - offsets[0]).tolist(), data.tobytes()
            hits = candidates(data) if len(data) else []
            ids = C.column(batch, "doc_id").to_pylist()
            got = [transform_text(raw[a:b], hits, a, i, plan, _CACHE) for a, b, i in zip(offsets, offsets[1:], ids)]
            n, form, output, prefix, middle = zip(*got)
            yield pa.RecordBatch.from_arrays(
                [C.column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(output, pa.binary()).cast(pa.string()),
                 pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())], names=["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"])
    return run


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, text) -> (doc_id, n, form, output, prefix_chars, middle_chars)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_transform(plan), OUT)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of (a transformed text holds no marker of its own)."""
    part = F.split(output, "<[PSM]>", -1)
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
