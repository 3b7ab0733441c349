"""Exact dedup of an incoming batch against immutable snapshots.

1. Every text is normalised (A-Z lowered), digested (SHA-256) and its first 64 bits taken as key.
2. A static binary-fuse filter is built for each snapshot and shard; shards are ranges of the key,
   as many as keep a shard below `SHARD_KEYS` distinct keys, so a filter is a bounded row.
3. Copies inside the incoming batch are grouped on their own (partial sums before the shuffle, so
   a huge group of copies is one row per task); their distinct digests pass the filters.
4. Positives join the exact buckets of the snapshots by digest; false positives find none.
5. Bytes are checked: each member of a group of two or more is compared with the group's
   representative; large groups are dealt over salts with one representative per salt.  Members that
   differ (a digest collision) form groups of their own by text.

The result has one row per input row.  The row with the largest doc_id of equal texts stays; of
repeated rows with that doc_id one stays.  A null text counts as empty, a null doc_id as smallest.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import common as C
from loomtext.llm import fuse

SHARD_KEYS = 1 << 16
#: Members of one group that are compared with one copy of its representative.
SALT_ROWS = 2048


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _digests(digest: Callable[[bytes], bytes], keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in C.slices(batches):
            norm = pc.ascii_lower(C.utf8(C.column(batch, "text"))).cast(pa.binary())
            d = [digest(x) for x in norm.to_pylist()]
            out = {x: C.column(batch, x) for x in batch.schema.names if x != "text"}
            out |= {"row": pa.array(np.arange(row, row + batch.num_rows)), "digest": pa.array(d, pa.binary()),
                    "key": pa.array([int.from_bytes(x[:8].ljust(8, b"\0"), "big", signed=True) for x in d], pa.int64())}
            row += batch.num_rows
            if keep_text:
                out["norm"] = norm
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
    return run


def _build(table: pa.Table) -> pa.Table:
    f = fuse.build(table["key"].to_numpy().view(np.uint64))
    return pa.table({"snapshot": table["snapshot"][:1], "shard": table["shard"][:1], "seed": pa.array([f.seed], pa.int32()),
                     "segment": pa.array([f.segment], pa.int32()), "segments": pa.array([f.segments], pa.int32()),
                     "slots": pa.array([f.slots.tobytes()], pa.binary())})


FILTERS = "snapshot int, shard long, seed int, segment int, segments int, slots binary"


def _screen(incoming: pa.Table, filters: pa.Table) -> pa.Table:
    keys = incoming["key"].to_numpy().view(np.uint64)
    maybe = np.zeros(len(keys), bool)
    for f in filters.to_pylist():
        maybe |= fuse.contains(fuse.Filter(f["seed"], f["segment"], f["segments"], np.frombuffer(f["slots"], np.uint16)), keys)
    return incoming.append_column("maybe", pa.array(maybe))


def build_filters(stored: DataFrame, bits: int) -> DataFrame:
    """(snapshot, key) -> one filter per snapshot and shard (the first `bits` bits of the key)."""
    shard = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    return (stored.select("snapshot", "key").distinct().withColumn("shard", shard)
            .groupBy("snapshot", "shard").applyInArrow(_build, FILTERS))


def dedup(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """(doc_id, text, snapshot) -> (doc_id, keep_id, group_size, kept, digest); `snapshot` is the
    number of the immutable snapshot that holds the row, null for rows of the incoming batch."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("snapshot").cast("int").alias("snapshot"))
    rows = C.materialise(docs.mapInArrow(_digests(digest, False),
                                         "doc_id long, snapshot int, row long, digest binary, key long"))
    best = F.max(F.struct("doc_id", "row")).alias("best")
    buckets = C.materialise(rows.where("snapshot is not null").groupBy("digest", "key").agg(F.count("*").alias("n"), best))
    batch = C.materialise(rows.where("snapshot is null").groupBy("digest", "key").agg(F.count("*").alias("n"), best))
    most = max(buckets.count(), batch.count(), 1)
    bits = max(0, math.ceil(math.log2(most / SHARD_KEYS)))
    filters = C.materialise(build_filters(rows.where("snapshot is not null"), bits))

    shard = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    asked = batch.select("digest", "key", "n", F.col("best.doc_id").alias("doc_id"), F.col("best.row").alias("row"), shard.alias("at"))
    screened = C.materialise(asked.groupBy("at").cogroup(filters.groupBy("shard")).applyInArrow(
        _screen, "digest binary, key long, n long, doc_id long, row long, at long, maybe boolean"))
    new = screened.select("digest", "n", F.struct("doc_id", "row").alias("best"), "maybe")
    exact = buckets.select(F.col("digest").alias("d"), F.col("n").alias("n0"), F.col("best").alias("best0"))
    found = new.where("maybe").join(exact, F.col("digest") == F.col("d"))
    merged = found.select("digest", (F.col("n") + F.col("n0")).alias("n"), F.greatest("best", "best0").alias("best"))
    alone = new.where("not maybe").select("digest", "n", "best").union(  # false positives stay alone too
        new.where("maybe").join(exact, F.col("digest") == F.col("d"), "left_anti").select("digest", "n", "best"))
    stored = buckets.select("digest", "n", "best").join(found.select("digest"), "digest", "left_anti")
    groups = C.materialise(merged.union(alone).union(stored))

    odd = _differing(docs, rows, groups, digest)
    if odd.limit(1).count():
        rows = rows.join(odd.select("doc_id", "digest", "norm").distinct(), ["doc_id", "digest"], "left")
        again = rows.groupBy("digest", "norm").agg(F.count("*").alias("n"), best)
        on = (F.col("digest") == F.col("d")) & F.col("norm").eqNullSafe(F.col("t"))
        out = rows.join(again.select(F.col("digest").alias("d"), F.col("norm").alias("t"), "n", "best"), on)
    else:
        out = rows.join(groups, "digest")
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                      (F.col("row") == F.col("best.row")).alias("kept"), "digest")


def _differing(docs: DataFrame, rows: DataFrame, groups: DataFrame, digest) -> DataFrame:
    """(doc_id, digest, norm) of members whose bytes differ from their group's representative."""
    large = groups.where("n > 1").select("digest", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"),
                                         F.col("best.doc_id").alias("chosen"))
    members = C.materialise(rows.join(large, "digest").select("doc_id", "digest", "salts", "chosen"))
    texts = C.join_small(docs.select("doc_id", "text"), members.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = texts.mapInArrow(_digests(digest, True), "doc_id long, row long, digest binary, key long, norm binary")
    texts = C.materialise(texts.join(large.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d")).drop("d", "row", "key"))
    chosen = texts.where(F.col("doc_id").eqNullSafe(F.col("chosen"))).groupBy("digest").agg(
        F.max("norm").alias("first"), F.max("salts").alias("s"))
    chosen = chosen.select("digest", "first", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"))
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    return C.materialise(salted.join(chosen, ["digest", "salt"]).where("norm <> first").select("doc_id", "digest", "norm"))
