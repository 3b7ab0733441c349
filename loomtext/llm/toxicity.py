"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-case letter runs.  Documents and examples are TF-IDF vectors over all terms of the
indexed examples, with document frequencies over all labelled rows of the learning folds; no term is
dropped.  A term significantly tied to a label (G-test and log odds over the same rows) weighs more.
Terms of a text that no example has count in its length alone.  Up to `max_examples` labelled rows, fewer
if their distinct terms are more than `max_terms` in all, form the index, a bounded and broadcast one: examples of the same vector make one entry with their
number and labels.

The index is inverted and has block maxima.  Entries are put into blocks of alike ones (halved again and
again along the main direction of a sketch of their vectors).  The terms in few entries are scored over
their postings; of the frequent terms each block keeps its largest weights, whose product with the text's
weights, added to the best posting score in the block, bounds every cosine in it.  The blocks with the
highest bounds are scored first and give a k-th cosine; of the others only those are scored (a dense
product over the texts that need the block) whose bound reaches it, the rest are skipped.  Scores are in
single precision; what can be among the nearest k within the rounding error is scored again in double
precision, so the neighbours are exact.  The cosines that choose, order and show neighbours are those of
these weights: TF-IDF times the factor of tied terms.  Votes weigh 1 / (distance + 0.05); the share of toxic votes is calibrated by pooled
adjacent violators on the learning rows, each scored without itself.

Null texts and texts without letters have no terms, hence no neighbours, and get the rate of the
learning rows.  Null or other labels are ignored; of a document labelled more than once the largest
label counts.  Of entries at the same cosine the earlier counts first.  Repeated rows are scored row by
row; an example never votes for a row with its own doc_id.
"""
from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm import common as C

TERM = regex.compile(r"\p{L}+")
#: At most so many terms, each in one of 50 entries at least, are scored as a dense matrix.
DENSE = 512
#: Above the error of a cosine summed in single precision.
ROUNDING = np.float32(2e-5)
#: Texts that are looked up together.
TOGETHER = 192
#: Entries of a block, and blocks that are scored first for each text.
BLOCK, FIRST = 128, 3


# ------------------------------------------------------------------ selection of terms
def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        seen: dict[str, list[int]] = {}
        for text, y in zip(C.utf8(C.column(batch, "text")).to_pylist(), C.column(batch, "y").to_pylist()):
            for term in set(TERM.findall(text.lower())):
                seen.setdefault(term, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([a for a, _ in seen.values()], pa.int64()),
                                          pa.array([b for _, b in seen.values()], pa.int64())], names=["term", "clean", "toxic"])


def term_weights(labelled: DataFrame, vocabulary: DataFrame, n_clean: int, n_toxic: int, g_least: float, odds_least: float) -> pa.Table:
    """(term, docs, factor) of all terms of the vocabulary, by term.  The factor is above 1 for
    terms tied to a label: it grows with the square root of G."""
    t = (labelled.mapInArrow(_tallies, "term string, clean long, toxic long")
         .groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")).join(vocabulary, "term", "left_semi"))
    n = n_clean + n_toxic
    part = lambda seen, rows: F.when(seen > 0, seen * F.log(seen * n / ((F.col("a") + F.col("b")) * rows))).otherwise(0.0)
    rest = lambda seen, rows: F.when(seen < rows, (rows - seen) * F.log((rows - seen) * n / ((n - F.col("a") - F.col("b")) * rows))).otherwise(0.0)
    g = 2 * (part(F.col("a"), F.lit(n_clean)) + part(F.col("b"), F.lit(n_toxic)) + rest(F.col("a"), F.lit(n_clean)) + rest(F.col("b"), F.lit(n_toxic)))
    odds = F.log((F.col("b") + 0.5) / (n_toxic - F.col("b") + 0.5)) - F.log((F.col("a") + 0.5) / (n_clean - F.col("a") + 0.5))
    tied = (F.col("g") >= g_least) & (F.abs("odds") >= odds_least)
    found = t.select("term", (F.col("a") + F.col("b")).alias("docs"), g.alias("g"), odds.alias("odds"))
    factor = F.when(tied, 1 + F.sqrt(F.col("g") / g_least)).otherwise(1.0).alias("factor")
    return found.select("term", "docs", factor).toArrow().combine_chunks().sort_by("term")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        found = [Counter(TERM.findall(t.lower())) for t in C.utf8(C.column(batch, "text")).to_pylist()]
        out = pa.RecordBatch.from_arrays(
            [C.column(batch, "doc_id"), C.column(batch, "y"), pa.array([list(c) for c in found], pa.list_(pa.string())),
             pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], names=["doc_id", "y", "terms", "tf"])
        yield out.filter(pa.array([bool(c) for c in found]))


# ------------------------------------------------------------------ index
@dataclass
class Index:
    """Entries by smallest doc_id with their unit vectors: entry e has the terms `terms` and weights
    `weights` from `start[e]` on, term t the entries `entry` and weights `weight` from `first[t]` on.
    An entry stands for `n` examples of one vector, `toxic` of them toxic, `ids` the smallest doc_id;
    `members` maps the doc_id of every example to its entry and label."""
    number: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    n: np.ndarray
    toxic: np.ndarray
    members: dict[int, tuple[int, int]]
    start: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    first: np.ndarray
    entry: np.ndarray
    weight: np.ndarray

    @cached_property
    def buffer(self) -> np.ndarray:
        """A vector over all terms, 0 between uses."""
        return np.zeros(len(self.idf))

    @cached_property
    def dense(self) -> "Dense":
        """The terms in most entries as a matrix whose columns are the entries in the order of the blocks."""
        df = np.diff(self.first)
        chosen = np.argsort(-df, kind="stable")[:DENSE]
        chosen = chosen[df[chosen] * 50 >= max(1, len(self.n))]
        column = np.full(len(df), -1)
        column[chosen] = np.arange(len(chosen))
        table = np.zeros((len(chosen), len(self.n)), np.float32)
        for j, t in enumerate(chosen.tolist()):
            at = slice(self.first[t], self.first[t + 1])
            table[j, self.entry[at]] = self.weight[at]
        order = alike(table)
        table = np.ascontiguousarray(table[:, order])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        starts = np.arange(0, len(order), BLOCK)
        tops = np.maximum.reduceat(table, starts, axis=1) if len(starts) else table
        return Dense(column, table, order, place.astype(np.int32)[self.entry], place, starts, tops)


@dataclass
class Dense:
    """column of each term or -1; table [column, place] of weights; order: the entry at each place, place: the
    reverse, entry_place: the same for the postings; starts of the blocks and their largest weights [column, block]."""
    column: np.ndarray
    table: np.ndarray
    order: np.ndarray
    entry_place: np.ndarray
    place: np.ndarray
    starts: np.ndarray
    tops: np.ndarray


def alike(table: np.ndarray, sketch: int = 32) -> np.ndarray:
    """Columns of a matrix in an order that puts alike ones into one block: halves along the main direction,
    down to blocks, of a random projection of them."""
    x = table.T @ np.random.default_rng(4).standard_normal((len(table), sketch)).astype(np.float32)
    todo, out = [np.arange(len(x))], []
    while todo:
        part = todo.pop()
        if len(part) <= BLOCK:
            out.append(part)
            continue
        y = x[part] - x[part].mean(0)
        direction = np.linalg.eigh(y.T.astype(float) @ y)[1][:, -1]
        part = part[np.argsort(y @ direction, kind="stable")]
        half = -(-len(part) // (2 * BLOCK)) * BLOCK
        todo += [part[half:], part[:half]]
    return np.concatenate([np.zeros(0, np.int64), *out])


def weigh(terms: list, n_docs: int) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of the terms, (term, documents) or (term, documents, factor), and the idf of each times
    its factor, and (last) the idf of a term no document has."""
    idf = lambda d, factor=1.0: (1 + math.log((n_docs + 1) / (d + 1))) * factor
    return {t[0]: i for i, t in enumerate(terms)}, np.array([idf(*t[1:]) for t in terms] + [idf(0)])


def counted(counts: Counter, number: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and unit weights (1 + log tf) idf; terms without a number share the last one,
    with the length of their vector as weight."""
    at = np.array(list(map(number.get, counts, repeat(-1))), np.int64)
    tf = 1 + np.log(np.array(list(counts.values()), np.float64))
    known = at >= 0
    terms = at[known]
    order = np.argsort(terms)
    terms = terms[order]
    w = (tf[known] * idf[at[known]])[order]
    if not known.all():
        terms, w = np.append(terms, len(number)), np.append(w, np.linalg.norm(tf[~known]) * idf[-1])
    return terms, w / np.linalg.norm(w) if len(w) else w


def vector(text: str, number: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a text and their unit weights."""
    return counted(Counter(TERM.findall(text.lower())), number, idf)


def build_index(examples: list, terms: list, n_docs: int, weighed: tuple | None = None) -> Index:
    """examples: (doc_id, label, term numbers, weights), in any order; `weighed`: what weigh gives, if known."""
    number, idf = weighed or weigh(terms, n_docs)
    groups: dict[bytes, list] = {}
    for e in sorted(examples, key=lambda e: e[0]):
        groups.setdefault(blake2b(e[2].tobytes() + np.round(e[3], 9).tobytes(), digest_size=32).digest(), []).append(e)
    entries = list(groups.values())
    t = np.concatenate([np.zeros(0, np.int64), *(g[0][2] for g in entries)]).astype(np.int32)
    w = np.concatenate([np.zeros(0), *(g[0][3] for g in entries)])
    lens = np.array([len(g[0][2]) for g in entries], np.int64)
    order = np.argsort(t, kind="stable")
    members = {x[0]: (i, x[1]) for i, g in enumerate(entries) for x in g}
    return Index(number, idf, np.array([g[0][0] for g in entries], np.int64), np.array([len(g) for g in entries], np.int64),
                 np.array([sum(x[1] for x in g) for g in entries], np.int64), members, np.concatenate([[0], np.cumsum(lens)]), t, w,
                 np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(idf)))]),
                 np.repeat(np.arange(len(entries), dtype=np.int32), lens)[order], w[order].astype(np.float32))


class Packed:
    """Terms and examples as broadcast: compressed counts, from which each worker builds its index."""

    def __init__(self, terms: pa.Table, sample: pa.Table, n_docs: int):
        flat = lambda c: sample[c].combine_chunks().flatten()
        t = pc.index_in(flat("terms"), value_set=terms["term"].combine_chunks()).to_numpy().astype(np.int32)
        lens = pc.list_value_length(sample["terms"]).to_numpy().astype(np.int64)
        order = np.lexsort((t, np.repeat(np.arange(len(lens)), lens)))
        t, tf = t[order], flat("tf").to_numpy()[order]
        parts = ("\n".join(terms["term"].to_pylist()), terms["docs"].to_numpy(), terms["factor"].to_numpy(), n_docs,
                 pc.fill_null(sample["doc_id"], -1).to_numpy(), sample["y"].to_numpy(), lens, np.diff(t, prepend=np.int32(0)), tf)
        self.data = zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts))

    @cached_property
    def index(self) -> Index:
        words, docs, factor, n_docs, ids, y, lens, t, tf = pickle.loads(zstandard.ZstdDecompressor().decompress(self.data))
        number = {w: i for i, w in enumerate(words.split("\n"))} if len(docs) else {}
        idf = np.append((1 + np.log((n_docs + 1) / (docs + 1))) * factor, 1 + math.log(n_docs + 1))
        t = np.cumsum(t, dtype=np.int32)
        ends = np.cumsum(lens)
        w = (1 + np.log(tf)) * idf[t]
        w /= np.repeat(np.sqrt(np.add.reduceat(w * w, ends - lens)), lens) if len(lens) else 1
        examples = [(i, label, t[b - m:b], w[b - m:b]) for i, label, b, m in zip(ids.tolist(), y.tolist(), ends.tolist(), lens.tolist())]
        return build_index(examples, [], n_docs, (number, idf))


def _ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges from a to b, one after another, and the length of each."""
    lens = b - a
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(a - (ends - lens), lens), lens


def block_scores(index: Index, vectors: list, k: int, without: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores [text, place], which (text, block) were scored, a bound that the k-th score of each text reaches).
    Scores of blocks that were skipped are -1, that of the entry `without` (-1: none) of each text is below
    all; every entry that may be among the k nearest has its score."""
    d = index.dense
    scores = np.zeros((len(vectors), len(d.order)), np.float32)
    q = np.zeros((len(vectors), len(d.table)), np.float32)
    for i, (terms, weights) in enumerate(vectors):
        j = d.column[terms]
        q[i, j[j >= 0]] = weights[j >= 0]
        rare, w = terms[j < 0], weights[j < 0]
        of, lens = _ranges(index.first[rare], index.first[rare + 1])
        scores[i] = np.bincount(d.entry_place[of], np.repeat(w, lens) * index.weight[of], len(d.order))
        if without[i] >= 0:
            scores[i, d.place[without[i]]] = -10
    blocks = len(d.starts)
    bounds = q @ d.tops + np.maximum.reduceat(scores, d.starts, axis=1)
    out = np.full((len(vectors), blocks * BLOCK), -1, np.float32)
    scored = np.zeros((len(vectors), blocks), bool)

    def score(wanted: np.ndarray) -> None:
        for b in np.flatnonzero(wanted.any(0)).tolist():
            rows, at = np.flatnonzero(wanted[:, b]), slice(b * BLOCK, min(b * BLOCK + BLOCK, len(d.order)))
            if 2 * len(rows) > len(vectors):  # most texts need it: all are multiplied, which is no dearer
                out[:, at] = np.where(wanted[:, b, None], scores[:, at] + q @ d.table[:, at], out[:, at])
            else:
                out[rows, at] = scores[rows, at] + q[rows] @ d.table[:, at]
        scored[wanted] = True

    least = np.full(len(vectors), -ROUNDING)
    if blocks > FIRST:
        first, highest = np.zeros_like(scored), np.argpartition(-bounds, FIRST, axis=1)[:, :FIRST]
        np.put_along_axis(first, highest, True, 1)
        score(first)
        best = out.reshape(len(vectors), blocks, BLOCK)[np.arange(len(vectors))[:, None], highest].reshape(len(vectors), -1)
        least = np.maximum(np.partition(best, -k, axis=1)[:, -k] - ROUNDING, least) if best.shape[1] >= k else least
    score((bounds >= least[:, None] - ROUNDING) & ~scored)
    return out, scored, least


def neighbours(index: Index, vectors: list, k: int, own: list) -> list[tuple]:
    """For each unit vector (terms, weights) the entries that hold the k examples of largest cosine (above 0),
    exact: (entries, cosines, examples, toxic ones), without the example of the doc_id in `own`."""
    none = np.zeros(0, np.int64)
    empty = (none, np.zeros(0), none, none)
    if not len(index.n) or not all(len(t) for t, _ in vectors):
        some = [i for i, (t, _) in enumerate(vectors) if len(t) and len(index.n)]
        found = dict(zip(some, neighbours(index, [vectors[i] for i in some], k, [own[i] for i in some]) if some else []))
        return [found.get(i, empty) for i in range(len(vectors))]
    mine = [index.members.get(o, (-1, 0)) for o in own]
    scores, _, least = block_scores(index, vectors, k, [e if e >= 0 and index.n[e] == 1 else -1 for e, _ in mine])
    out = []
    for v, s, low, m in zip(vectors, scores, least, mine):
        at = np.flatnonzero(s >= low)
        if len(at) > k:  # k entries other than `mine`'s remainder hold k examples at least
            at = at[s[at] >= np.partition(s[at], -k)[-k] - ROUNDING]
        out.append(_exact(index, *v, np.sort(index.dense.order[at]), k, *m))
    return out


def _exact(index: Index, terms: np.ndarray, weights: np.ndarray, at: np.ndarray, k: int, mine: int, label: int) -> tuple:
    """The nearest of the entries `at`, by cosines in double precision."""
    query = index.buffer
    query[terms] = weights
    of, lens = _ranges(index.start[at], index.start[at + 1])
    cosines = np.add.reduceat(index.weights[of] * query[index.terms[of]], np.cumsum(lens) - lens) if len(at) else np.zeros(0)
    query[terms] = 0
    at, cosines = at[cosines > 0], cosines[cosines > 0]
    best = np.lexsort((at, -np.round(cosines, 12)))
    found, cosines = at[best], cosines[best]
    reach = int(np.searchsorted(np.cumsum(index.n[found] - (found == mine)), k)) + 1
    found, cosines = found[:reach], cosines[:reach]
    is_mine = (found == mine).astype(np.int64)
    return found, cosines, index.n[found] - is_mine, index.toxic[found] - is_mine * label


def vote(cosines: np.ndarray, n: np.ndarray, toxic: np.ndarray, k: int) -> float | None:
    """Share of toxic votes among the nearest k examples, weighing 1 / (distance + 0.05)."""
    if not len(n):
        return None
    before = np.cumsum(n) - n
    w = np.minimum(n, k - before) / (1 - np.minimum(cosines, 1) + 0.05)
    return float(w @ (toxic / n) / w.sum())


RAW = "doc_id long, held_out boolean, raw double, evidence array<struct<doc_id: long, n: long, toxic: long, cosine: double>>"
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("toxic", pa.int64()), ("cosine", pa.float64())]))


def _votes(sent, k: int, shown: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value.index
        for batch in C.slices(batches):
            ids = C.column(batch, "doc_id")
            raw, evidence = [], []
            own, texts = ids.to_pylist(), C.utf8(C.column(batch, "text")).to_pylist()
            for a in range(0, len(texts), TOGETHER):
                vectors = [vector(t, index.number, index.idf) for t in texts[a:a + TOGETHER]]
                for found, cosine, n, toxic in neighbours(index, vectors, k, own[a:a + TOGETHER]):
                    raw.append(vote(cosine, n, toxic, k))
                    evidence.append([{"doc_id": int(index.ids[f]), "n": int(m), "toxic": int(y), "cosine": float(c)}
                                     for f, c, m, y in zip(found[:shown], cosine, n, toxic)])
            yield pa.RecordBatch.from_arrays([ids, C.column(batch, "held_out"), pa.array(raw, pa.float64()), pa.array(evidence, _EVIDENCE)],
                                             names=["doc_id", "held_out", "raw", "evidence"])
    return run


# ------------------------------------------------------------------ calibration
def isotonic(cells: list[tuple[float, int, int]]) -> list[tuple[float, float]]:
    """(raw, rows, toxic) in order of raw -> (raw, rate), rates pooled until they do not fall."""
    pools: list[list] = []
    for raw, n, ones in cells:
        pools.append([[raw], n, ones])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            a, b = pools.pop(-2), pools.pop(-1)
            pools.append([a[0] + b[0], a[1] + b[1], a[2] + b[2]])
    return [(raw, (ones + 0.5) / (n + 1)) for raws, n, ones in pools for raw in raws]


def toxicity_scores(docs: DataFrame, labels: DataFrame, held: Column, k: int = 15, max_examples: int = 20_000, max_terms: int = 16 << 20,
                    g_least: float = 25.0, odds_least: float = 1.0, shown: int = 3) -> DataFrame:
    """(doc_id, text), (doc_id, toxic) -> (doc_id, held_out, score, evidence).  Labels count only where
    `held` (an expression over doc_id) is false.  All such rows weigh the terms; the index holds
    those of lowest hash, about `max_examples` with `max_terms` (distinct in their text) in all."""
    spark = docs.sparkSession
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"), held.alias("h"))
    known = C.materialise(labels.where("not h and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    labelled = C.join_small(rows, known, "doc_id", "inner").select("doc_id", "text", "y")
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    rate = (ones + 0.5) / (n + 1)

    hashed, share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), int((1 << 20) * min(1.0, max_examples / max(n, 1)))
    sample = C.materialise(labelled.where(hashed < share)
                           .mapInArrow(_counts, "doc_id long, y int, terms array<string>, tf array<int>"))
    size = sample.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    if size > max_terms:  # long texts: fewer examples, by the same hash
        sample = C.materialise(sample.where(hashed < int(share * max_terms / size)))
    vocabulary = sample.select(F.explode("terms").alias("term")).distinct()
    terms = term_weights(labelled, vocabulary, n - ones, ones, g_least, odds_least)
    sent = spark.sparkContext.broadcast(Packed(terms, sample.toArrow(), n))
    raw = C.materialise(rows.mapInArrow(_votes(sent, k, shown), RAW))

    # calibration on the learning rows, in cells of one fortieth
    cell = F.round(F.col("raw") * 40) / 40
    table = (raw.join(known, "doc_id").groupBy(F.coalesce(cell, F.lit(-1.0)).alias("c"))
             .agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("c").collect())
    curve = [(-1.0, rate)]
    curve += [(c, (ones + 0.5) / (m + 1)) for c, m, ones in table if c < 0]
    steps = isotonic([(c, m, ones) for c, m, ones in table if c >= 0])
    score = F.lit(steps[0][1] if steps else rate)
    for c, p in steps[1:]:
        score = F.when(F.col("raw") >= c - 0.0125, F.lit(p)).otherwise(score)
    score = F.when(F.col("raw").isNull(), F.lit(curve[-1][1])).otherwise(score)
    return raw.select("doc_id", "held_out", score.cast("double").alias("score"), "evidence")
