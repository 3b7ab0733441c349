"""Helpers shared by the operators: folds, Arrow slices, whitespace tokens, shared scratch tables."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.session import ensure_checkpoint_dir

#: Words of the contracts: runs of bytes other than ASCII space and \t \n \v \f \r.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Text handled at once inside a task; longer single texts are handled alone.
SLICE_BYTES = 2 << 20
#: A side joined by broadcast is first counted; above this number of rows it is shuffled instead.
BROADCAST_ROWS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(folds))


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared checkpoint folder and read back: cuts lineage, survives lost
    executors, and later scans prune columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(left: DataFrame, right: DataFrame, on, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a materialised `right`: by broadcast if a count proves it small, else by shuffle."""
    small = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if small else right, on, how)


def utf8(column: pa.Array) -> pa.Array:
    """Strings without nulls (null counts as empty)."""
    return pc.fill_null(column.cast(pa.string()), "")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about `limit` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Whitespace words of every text: (all words in order, number of words of each text)."""
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    real = pc.greater(pc.binary_length(flat), 0)
    seen = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), np.diff(seen[offsets])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
