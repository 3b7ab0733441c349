"""ST1: categorise newly arriving questions against existing categories as a stream.

A short keyword list becomes a literal map, so each micro-batch is a stateless per-row projection
(no shuffle, no state store).  For a longer list each micro-batch is matched as a batch (foreachBatch):
its tokens are joined with the keyword table.  Either way the result of a stream equals the batch MT1
result on the same rows, and each row is matched on its own.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import match as MT


def categorize_stream(stream: DataFrame, keywords: DataFrame, freq: DataFrame,
                      id_col: str = "id", text_col: str = "question") -> DataFrame:
    """Streaming DataFrame of (id, label), for keyword lists short enough for the map form; see
    `match_stream` for any list."""
    rows = short_keywords(MT.keyword_frequencies(keywords, freq))
    if rows is None:
        raise ValueError("too many keywords for a literal map: use match_stream")
    return MT._match_by_array(stream, rows, id_col, text_col)


def short_keywords(kw_freq: DataFrame) -> list | None:
    """[(keyword, freq)] if there are few enough for the map form, else None."""
    rows = [(r["keyword"], r["freq"]) for r in kw_freq.limit(MT.ARRAY_MATCH_MAX_KEYWORDS + 1).collect()]
    return rows if len(rows) <= MT.ARRAY_MATCH_MAX_KEYWORDS else None


def match_stream(stream: DataFrame, keywords: DataFrame, freq: DataFrame, sink_dir: str, checkpoint_dir: str,
                 id_col: str = "id", text_col: str = "question"):
    """Start the stream that appends (id, label) to `sink_dir`; returns the streaming query."""
    kw_freq = MT.keyword_frequencies(keywords, freq)
    rows = short_keywords(kw_freq)
    if rows is not None:
        writer = MT._match_by_array(stream, rows, id_col, text_col).writeStream.format("parquet").option("path", sink_dir)
    else:
        def batch(df: DataFrame, number: int) -> None:  # rerun of a batch overwrites its own folder
            MT._match_by_join(df, kw_freq, id_col, text_col).write.mode("overwrite").parquet(f"{sink_dir}/batch={number}")
        writer = stream.writeStream.foreachBatch(batch)
    return writer.option("checkpointLocation", checkpoint_dir).outputMode("append").trigger(availableNow=True).start()


def run_available_now(spark: SparkSession, source_dir: str, schema: str, keywords: DataFrame, freq: DataFrame,
                      sink_dir: str, checkpoint_dir: str, fmt: str = "parquet") -> DataFrame:
    """Reads every file present in `source_dir` as a stream (availableNow trigger), appends
    (id, label) to `sink_dir` and returns the sink contents."""
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    match_stream(stream, keywords, freq, sink_dir, checkpoint_dir).awaitTermination()
    return spark.read.parquet(sink_dir).select("id", "label")
