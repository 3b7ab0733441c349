"""VEC7 / SO4: a fitted corpus model (vocabulary, document frequencies, idf) kept as versioned tables and applied
to later batches or to a stream.

A version is complete once its row is in `<path>/corpora`, which is written after its terms; a fit that was cut
short leaves no such row, and the next fit overwrites its terms.  Versions are never changed.  Two fits at one path
must not run at the same time.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import weights as W
from loomtext.operators.skew import salted_join
from loomtext.session import DEFAULT_BROADCAST_BYTES, broadcast_if_small


@dataclass
class CorpusModel:
    version: int
    n_docs: int
    terms: DataFrame  # (lemma, df, idf)


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("version INT, n_docs LONG").parquet(f"{path}/corpora")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def fit_corpus(tokens: DataFrame, path: str, n_docs: int | None = None, max_df: float | None = None) -> int:
    """Fits (lemma, df, smoothed idf) on tokens (id, lemma), one row per occurrence, and writes them as the next
    version under `path`; returns its number.  `n_docs` counts documents without a token too; by default only those
    with one count.  Terms in more than the share `max_df` of documents are left out.  An empty corpus gives
    a version without terms."""
    spark = tokens.sparkSession
    known = _versions(spark, path)
    version = 1 + ((known.agg(F.max("version")).first()[0] or 0) if known is not None else 0)
    pairs = tokens.where(F.col("lemma").isNotNull()).select("id", "lemma").distinct()
    n = n_docs if n_docs is not None else pairs.select("id").distinct().count()
    df = pairs.groupBy("lemma").agg(F.count(F.lit(1)).alias("df"))
    if max_df is not None:
        df = df.where(F.col("df") <= F.lit(max_df * n))
    df.withColumn("idf", F.ln(F.lit(1.0 + n) / (F.col("df") + 1)) + 1).write.mode("overwrite").parquet(f"{path}/terms/version={version}")
    spark.createDataFrame([(version, n)], "version INT, n_docs LONG").write.mode("append").parquet(f"{path}/corpora")
    return version


def load_corpus(spark: SparkSession, path: str, version: int | None = None) -> CorpusModel:
    """The given version, or the latest complete one; an error if there is none."""
    known = _versions(spark, path)
    if known is None:
        raise ValueError(f"no corpus model at {path}")
    rows = known if version is None else known.where(F.col("version") == version)
    row = rows.orderBy(F.col("version").desc()).first()
    if row is None:
        raise ValueError(f"no version {version} of the corpus model at {path}")
    terms = spark.read.schema("lemma STRING, df LONG, idf DOUBLE").parquet(f"{path}/terms/version={row['version']}")
    return CorpusModel(row["version"], row["n_docs"], terms)


def weigh(model: CorpusModel, tokens: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """(id, lemma, tf, w): sublinear tf-idf of tokens (id, lemma) by the model's idf, each document of length 1.
    Terms the model does not know are left out, so a document may have no row.  A vocabulary beyond the broadcast
    bound is joined by key, frequent words dealt over salts."""
    tf = W.text_frequency(tokens.where(F.col("lemma").isNotNull()))
    terms = model.terms.select("lemma", "idf")
    small = broadcast_if_small(terms, max_bytes=max_bytes)
    joined = tf.join(small, "lemma") if small is not terms else salted_join(tf, terms, ["lemma"])
    raw = joined.select("id", "lemma", "tf", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "lemma", "tf", (F.col("w") / F.col("norm")).alias("w"))


def weigh_stream(stream: DataFrame, model: CorpusModel, sink_dir: str, checkpoint_dir: str):
    """Weighs a stream of (id, lemmas ARRAY<STRING>), one row per document, into `sink_dir`, a folder per micro-batch
    that a rerun of the batch overwrites; returns the streaming query (it ends with the input present)."""
    def batch(docs: DataFrame, number: int) -> None:
        weigh(model, docs.select("id", F.explode("lemmas").alias("lemma"))).write.mode("overwrite").parquet(f"{sink_dir}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
