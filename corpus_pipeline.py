"""Corpus pipeline over `documents`: quality classifier, line dedup, SimHash near-dedup, mixing of
sources, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result, written
as Parquet and read again, is the next stage's docs.  All but the last return the columns of docs.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm import bpe, line_dedup, mixing, pu, simhash
from loomtext.llm import common as C


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3, row by row: null texts are scored as empty ones, repeated
    rows stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return pu.keep_quality(docs, labels, C.fold(F.col("doc_id"), 5) == 0, threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that more than 1% of their source's documents (and 5 at least) share.
    Null texts become empty; repeated rows, null and repeated ids count as line_dedup says."""
    out = line_dedup.drop_boilerplate(docs, "doc_id", F.col("source"), max_ratio=0.01, min_pages=5)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id (null ids last; among
    equal ones any).  Rows are told apart by a number of their own, so repeated rows are copies like
    others, rows that share an id but not the text are documents of their own, and so are rows without one."""
    row, doc = "row of near_copies", F.col("doc_id")
    numbered = C.materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    found = simhash.near_duplicates(numbered.select(F.col(f"`{row}`").alias("doc_id"), "text"), shingle=4, max_bits=4)
    found = C.materialise(found.select(F.col("doc_id").alias("r"), "component_id"))
    ids = numbered.select(F.col(f"`{row}`").alias("r"), doc.isNull().alias("unknown"), doc.alias("id"))
    first = found.join(ids, "r").groupBy("component_id").agg(F.min(F.struct("unknown", "id", "r")).alias("first"))
    gone = C.materialise(found.select("r").join(first.select(F.col("first.r").alias("r")), "r", "left_anti"))
    return C.join_small(numbered, gone.withColumnRenamed("r", row), row, "left_anti").drop(row)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (DataFrame operations only).  Null texts hold no words and stay
    once; repeated rows are taken row by row."""
    taken = mixing.mix(docs)
    # rows are matched by doc_id and size, numbered among rows that repeat both
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    left = docs.select(row, F.col("doc_id").alias("id"), mixing.word_count(F.col("text").cast("string")).alias("size"))
    left = left.withColumn("n", F.row_number().over(Window.partitionBy("id", "size").orderBy("size")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "size").orderBy("copies"))
    right = taken.select(F.col("doc_id").alias("of"), F.col("size").alias("of_size"), nth.alias("of_n"), "copies")
    on = F.col("id").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")) & (F.col("n") == F.col("of_n"))
    out = left.join(right.where("copies > 0"), on)
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every text, and digests of ids and decoded bytes.  Null texts
    have no ids; repeated rows are encoded row by row."""
    out = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies),
          ("mixing sources to target weights", mix), ("byte-level BPE encoding and decoding", encode)]
#: A trained classifier and a byte-pair encoder cannot be expressed in SQL; the tests compare with
#: brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = C.materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
