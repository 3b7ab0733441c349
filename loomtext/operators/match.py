"""MT1 / ST1: put each question into the rarest pre-created category whose keyword it contains."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.session import DEFAULT_BROADCAST_ROWS

UNCATEGORIZED = "uncategorized"
# Up to this many keywords the match is a per-row array expression (no shuffle at all);
# above it the token stream is hash-joined against the broadcast keyword table.
ARRAY_MATCH_MAX_KEYWORDS = 256


def keyword_frequencies(keywords: DataFrame, freq: DataFrame) -> DataFrame:
    """(keyword, freq): background frequency of each category keyword, unknown -> 0 (JN2)."""
    f = freq.select(F.col("lemma").alias("keyword"), "freq")
    return keywords.select("keyword").distinct().join(f, "keyword", "left").select(
        "keyword", F.coalesce("freq", F.lit(0.0)).alias("freq")
    )


def _match_by_array(questions: DataFrame, kw_rows: list, id_col: str, text_col: str) -> DataFrame:
    """Narrow form used for small keyword lists and for streams: every question row is
    matched against a literal keyword->frequency map; no shuffle."""
    kw_map = F.create_map(*[x for k, f in kw_rows for x in (F.lit(k), F.lit(float(f)))]) if kw_rows \
        else F.create_map().cast("map<string,double>")
    lem = F.array_distinct(T.lemmas(T.clean_text(T.strip_newlines(text_col))))
    hits = F.filter(lem, lambda x: F.map_contains_key(kw_map, x))
    best = F.array_min(F.transform(hits, lambda x: F.struct(F.element_at(kw_map, x).alias("freq"), x.alias("kw"))))
    return questions.select(
        F.col(id_col).alias("id"),
        F.coalesce(best["kw"], F.lit(UNCATEGORIZED)).alias("label"),
    )


def _match_by_join(questions: DataFrame, kw_freq: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Large keyword lists: explode tokens, broadcast hash join, then one aggregation by question
    that is partially aggregated before the shuffle (one row per question leaves each task)."""
    # a row is its own key: repeated ids stay separate rows, as in the array form
    rows = questions.select(F.col(id_col).alias("id"), F.col(text_col), F.monotonically_increasing_id().alias("row"))
    toks = rows.select(
        "row", "id",
        F.explode_outer(T.lemmas(T.clean_text(T.strip_newlines(text_col)))).alias("lemma"),
    )
    kw = kw_freq.withColumnRenamed("keyword", "lemma")
    joined = toks.join(F.broadcast(kw) if kw_freq.count() <= DEFAULT_BROADCAST_ROWS else kw, "lemma", "left")
    best = joined.groupBy("row", "id").agg(
        F.min(F.when(F.col("freq").isNotNull(), F.struct("freq", F.col("lemma").alias("kw")))).alias("b")
    )
    return best.select("id", F.coalesce(F.col("b.kw"), F.lit(UNCATEGORIZED)).alias("label"))


def match_categories(questions: DataFrame, keywords: DataFrame, freq: DataFrame,
                     id_col: str = "id", text_col: str = "question", method: str = "auto") -> DataFrame:
    """MT1: (id, label). A question whose lemmas contain none of the keywords is
    'uncategorized'; otherwise it takes the keyword with the lowest background frequency
    (frequency 0 wins), ties broken by keyword."""
    kw_freq = keyword_frequencies(keywords, freq)
    if method == "auto":
        n = kw_freq.limit(ARRAY_MATCH_MAX_KEYWORDS + 1).count()
        method = "array" if n <= ARRAY_MATCH_MAX_KEYWORDS else "join"
    if method == "array":
        rows = [(r["keyword"], r["freq"]) for r in kw_freq.limit(ARRAY_MATCH_MAX_KEYWORDS + 1).collect()]
        if len(rows) > ARRAY_MATCH_MAX_KEYWORDS:
            raise ValueError("keyword list too large for the array form; use method='join'")
        return _match_by_array(questions, rows, id_col, text_col)
    return _match_by_join(questions, kw_freq, id_col, text_col)
