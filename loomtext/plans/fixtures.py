"""Derived fixtures built by Spark from the given tables: question corpora,
token tables, background frequency, keyword list, stop list."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.sources import tables as S


def doc_questions(spark: SparkSession, sf: str) -> DataFrame:
    return S.documents_as_questions(spark, sf)


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(id, lang, pos, token, lemma) over all documents."""
    q = S.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("question"), "lang")
    t = S.token_table(q.select("id", "question"))
    return t.join(q.select("id", "lang"), "id")


_MEMO: dict = {}


def _memo(spark: SparkSession, sf: str, name: str, build):
    """Fixtures shared by several queries of one session are built once and persisted
    (memory and disk); they are recomputable from their lineage if an executor is lost."""
    key = (id(spark.sparkContext._jsc), sf, name)
    if key not in _MEMO:
        v = build()
        if isinstance(v, DataFrame):
            from pyspark import StorageLevel

            v = v.persist(StorageLevel.MEMORY_AND_DISK)
        _MEMO[key] = v
    return _MEMO[key]


def doc_lemmas(spark: SparkSession, sf: str) -> DataFrame:
    """(id, lang, lemmas ARRAY<STRING>) of the cleaned documents, a row each; kept as text (no lemma holds a space)."""
    from loomtext.functions import text as T

    words = _memo(spark, sf, "doc_words", lambda: S.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "lang", F.array_join(T.lemmas(T.question_text("text")), " ").alias("words")))
    return words.select("id", "lang", F.filter(F.split("words", " "), lambda w: w != "").alias("lemmas"))


def doc_token_lemmas(spark: SparkSession, sf: str) -> DataFrame:
    """(id, lang, lemma) without positions: the token stream of the cleaned documents."""
    return doc_lemmas(spark, sf).select("id", "lang", F.explode("lemmas").alias("lemma"))


def background(spark: SparkSession, sf: str) -> DataFrame:
    return _memo(spark, sf, "background", lambda: S.background_frequency(doc_token_lemmas(spark, sf)))


def n_docs(spark: SparkSession, sf: str) -> int:
    return _memo(spark, sf, "n_docs", lambda: S.table(spark, sf, "documents").count())


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    return _memo(spark, sf, "keywords", lambda: S.derived_keywords(S.lemma_documents(doc_lemmas(spark, sf)), n_docs(spark, sf)))


def stop_list(spark: SparkSession, sf: str) -> DataFrame:
    return _memo(spark, sf, "stop", lambda: S.derived_stop_list(S.lemma_documents(doc_lemmas(spark, sf), "lang")))


def release() -> None:
    """Forget the shared fixtures and free what the executors keep of them."""
    for v in _MEMO.values():
        if isinstance(v, DataFrame):
            v.unpersist()
    _MEMO.clear()
