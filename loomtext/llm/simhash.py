"""SimHash near-dedup with pivot distance tables.

Fingerprints are the majority bits of the XXH64 values of the word shingles.  Two fingerprints link
at `max_bits` or fewer differing bits.  Work is done on distinct fingerprints:

1. Distribution.  The 64 bits are cut in `max_bits + 2` blocks; two linked fingerprints agree in
   two blocks at least, so they meet in the bucket of one pair of blocks (exact, no candidate is
   lost).  Distances to reference fingerprints alone would not bound the pairs: for 64 near-random
   bits every coordinate lies within a few units of 32, and a cell grid over m coordinates copies
   each row about 2^m times for less than one bit of selectivity per coordinate.
2. Inside a bucket, a pivot table holds the Hamming distance of every fingerprint to `pivots`
   reference fingerprints.  A pair is discarded if any coordinate differs by more than `max_bits`
   (triangle inequality); survivors are verified on the 64 bits.
3. A crowded bucket is first contracted: a member is taken as pivot, everything within `max_bits`
   of it is linked to it, and only members of other groups within its reach remain to compare, so
   a group of many near copies costs a few sweeps instead of all its pairs.  Crowded buckets are cut
   into tiles of bounded size that meet in separate tasks.

Each bucket emits the links of a spanning forest, never all pairs; components follow.

Fewer words than the shingle length make one shingle of the whole sequence; null, empty and blank
texts have the fingerprint zero, linked like any other.  Repeated rows stay repeated.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import common as C
from loomtext.llm.components import components

SEED = 42


# ------------------------------------------------------------------ fingerprints
def fingerprints(text: pa.Array, shingle: int) -> np.ndarray:
    """Fingerprint of every text as uint64."""
    flat, lens = C.words(pc.ascii_lower(text))
    out = np.zeros(len(lens), np.uint64)
    if not len(flat):
        return out
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = b" ".join(flat.cast(pa.binary()).to_pylist())
    start = np.cumsum(size + 1) - size - 1
    end = start + size
    per = np.where(lens > 0, np.maximum(lens - shingle + 1, 1), 0)
    first = np.cumsum(lens) - lens
    doc = np.repeat(np.arange(len(lens)), per)
    a = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    b = np.minimum(a + shingle, first[doc] + lens[doc]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[x:y], SEED) for x, y in zip(start[a].tolist(), end[b].tolist())), np.uint64, len(doc))
    full = np.flatnonzero(per > 0)
    edges = np.append((np.cumsum(per) - per)[full], len(h))
    for lo in range(0, len(full), 256):  # bounds the unpacked bits
        x, y = edges[lo], edges[min(lo + 256, len(full))]
        bits = np.unpackbits(h[x:y].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, edges[lo:min(lo + 256, len(full))] - x, axis=0, dtype=np.int64)
        major = 2 * ones > per[full[lo:lo + 256]][:, None]
        out[full[lo:lo + 256]] = np.packbits(major, axis=1).view(">u8").ravel()
    return out


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            f = fingerprints(C.utf8(C.column(batch, "text")), shingle)
            yield pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), pa.array(f.view(np.int64))], names=["doc_id", "fp"])
    return run


def fingerprint_documents(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp), fp the 64 bits as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


# ------------------------------------------------------------------ buckets
def block_bounds(max_bits: int) -> list[tuple[int, int]]:
    cuts = [round(64 * i / (max_bits + 2)) for i in range(max_bits + 3)]
    return list(zip(cuts, cuts[1:]))


def _keys(max_bits: int) -> list:
    """One (table, value) column per pair of blocks."""
    part = lambda lo, hi: F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
    return [F.struct(F.lit(t).alias("t"), (F.shiftleft(part(*p), q[1] - q[0]) + part(*q)).alias("key"))
            for t, (p, q) in enumerate(combinations(block_bounds(max_bits), 2))]


def pivot_references(n: int) -> np.ndarray:
    """Fixed reference fingerprints (hashes of their numbers)."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def bucket_links(group: np.ndarray, fp: np.ndarray, max_bits: int, references: np.ndarray, crowded: int = 48):
    """Links (index pairs) that connect each bucket as all its true links do; `group` is sorted.
    At most one link per member is returned."""
    table = hamming(fp[:, None], references[None]).astype(np.int8)
    found_a, found_b = [], []
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    size = np.diff(edges)
    behind = np.repeat(edges[1:], size) - np.arange(len(fp)) - 1  # members after this one
    behind[np.repeat(size > crowded, size)] = 0
    for step in range(1, crowded):
        i = np.flatnonzero(behind >= step)
        if not len(i):
            break
        i, j = _verify(i, i + step, fp, table, max_bits)
        found_a.append(i)
        found_b.append(j)
    for g in np.flatnonzero(size > crowded):
        a, b = crowded_links(fp[edges[g]:edges[g + 1]], max_bits)
        found_a.append(a + edges[g])
        found_b.append(b + edges[g])
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *found_a]), np.concatenate([none, *found_b])
    label = np.arange(len(fp))
    while len(a):  # smallest index reachable, by links and pointer jumps
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, label[a], low)
        label = label[label]
    member = np.flatnonzero(label != np.arange(len(fp)))
    return member, label[member]


def _verify(i, j, fp, table, max_bits):
    """Discard pairs by maximum coordinate difference, verify survivors by the bits."""
    for p in range(table.shape[1]):
        near = np.abs(table[i, p] - table[j, p]) <= max_bits
        i, j = i[near], j[near]
    near = hamming(fp[i], fp[j]) <= max_bits
    return i[near], j[near]


def crowded_links(fp: np.ndarray, max_bits: int):
    """Links of one crowded bucket, by sweeps whose pivots are members.

    A pivot links to everything within max_bits of it.  A member at distance r from the pivot can
    only link to members within max_bits + r of the pivot; if all of those already share the
    pivot's group, the member is settled and needs no sweep of its own."""
    n = len(fp)
    label, out_a, out_b = np.arange(n), [], []
    todo = np.arange(n)
    while len(todo):
        centre, todo = todo[0], todo[1:]
        d = hamming(fp, fp[centre])
        near = np.flatnonzero(d <= max_bits)
        roots, first = np.unique(label[near], return_index=True)
        other = roots != label[centre]
        if other.any():
            out_a.append(near[first[other]])
            out_b.append(np.full(int(other.sum()), centre))
            label[np.isin(label, roots)] = label[centre]
        strange = d[label != label[centre]]
        nearest = int(strange.min()) if len(strange) else 65 + max_bits
        todo = todo[d[todo] > nearest - max_bits - 1]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


#: Rows of small buckets compared at once, and members of a bucket (or tile of one) that meet in a task.
ROWS, TILE = 1 << 17, 1 << 13


def _links(max_bits: int, pivots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references, held, rows = pivot_references(pivots), [], 0

        def links(bucket, pair, fp):
            change = np.r_[True, (bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1])]
            a, b = bucket_links(np.cumsum(change), fp.view(np.uint64), max_bits, references)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

        def flush(last: bool):
            nonlocal held, rows
            bucket, pair, fp = (np.concatenate([h[i] for h in held]) for i in range(3))
            cut = len(fp)
            if not last:  # the bucket at the end may go on in the next batch
                cut = int(np.flatnonzero((bucket != bucket[-1]) | (pair != pair[-1])).max(initial=-1)) + 1
            held, rows = [(bucket[cut:], pair[cut:], fp[cut:])], len(fp) - cut
            if cut:
                yield links(bucket[:cut], pair[:cut], fp[:cut])

        limit = ROWS
        for batch in batches:
            held.append(tuple(C.column(batch, x).to_numpy() for x in ("bucket", "pair", "fp")))
            rows += batch.num_rows
            if rows >= limit:
                yield from flush(False)
                limit = rows + ROWS
        if rows:
            yield from flush(True)
    return run


def links(distinct: DataFrame, max_bits: int, pivots: int = 16) -> DataFrame:
    """(fp) distinct -> (a, b): links between fingerprints that span each group of true links."""
    rows = distinct.select("fp", F.explode(F.array(*_keys(max_bits))).alias("k"))
    rows = rows.select("fp", (F.shiftleft(F.col("k.t").cast("long"), 32) + F.col("k.key")).alias("bucket"))
    crowded = C.materialise(rows.groupBy("bucket").count().where(F.col("count") > TILE)
                            .select("bucket", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    dealt = C.join_small(rows, crowded, "bucket").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1),
                        lambda i: F.least(i, tile) * F.col("tiles") + F.greatest(i, tile))
    dealt = dealt.select("bucket", F.explode(pairs).alias("pair"), "fp")
    return (dealt.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")
            .mapInArrow(_links(max_bits, pivots), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, component_id): component_id is the smallest doc_id reachable."""
    prints = C.materialise(fingerprint_documents(docs, shingle))
    distinct = C.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(distinct.select("fp"), max_bits))
    group = (distinct.join(found, distinct["fp"] == found["node"], "left")
             .select("fp", "first_id", F.coalesce("component", "fp").alias("root")))
    lowest = group.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(group.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
