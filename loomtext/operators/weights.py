"""Term statistics and weights (AG1-AG7, JN1, JN2, FLT2, FLT3, VEC3, VEC5).

All tables are long: (id, term, ...).  Corpus-wide scalars (document count) are single
aggregates; per-term statistics are partial/final hash aggregations, so a hot term never
lands in one task.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import broadcast_if_small

UNKNOWN_FREQ = 1e-9  # Appendix B-2: intended value for words missing from the frequency table


def text_frequency(tokens: DataFrame, term_col: str = "lemma") -> DataFrame:
    """AG1: (id, term, tf)."""
    return tokens.groupBy("id", term_col).agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame, term_col: str = "lemma") -> DataFrame:
    """AG2: (term, df) from the AG1 table (one row per (id, term) already)."""
    return tf.groupBy(term_col).agg(F.count(F.lit(1)).alias("df"))


def idf_plain(df: DataFrame, n_docs: int) -> DataFrame:
    """AG3: idf = ln(N / df)."""
    return df.withColumn("idf", F.ln(F.lit(float(n_docs)) / F.col("df")))


def global_idf(freq_col, unknown_freq: float = UNKNOWN_FREQ):
    """AG5: -ln(freq) with missing / zero frequency replaced by `unknown_freq`."""
    f = F.coalesce(F.when(freq_col > 0, freq_col), F.lit(unknown_freq))
    return -F.ln(f)


def tfidf(tf: DataFrame, n_docs: int, freq: DataFrame | None = None, term_col: str = "lemma",
          unknown_freq: float = UNKNOWN_FREQ) -> DataFrame:
    """AG4 (+JN1, JN2): per-document tf*ln(N/df) and global tf*(-ln freq)."""
    idf = idf_plain(document_frequency(tf, term_col), n_docs).select(term_col, "idf")
    out = tf.join(idf, term_col).withColumn("tfidf", F.col("tf") * F.col("idf"))
    if freq is not None:
        # the frequency table is as large as the vocabulary: leave the join strategy to AQE
        out = out.join(freq.select(F.col("lemma").alias(term_col), "freq"), term_col, "left")
        out = out.withColumn("global_tfidf", F.col("tf") * global_idf(F.col("freq"), unknown_freq)).drop("freq")
    return out


def postings(tokens: DataFrame, term_col: str = "lemma") -> DataFrame:
    """AG6: inverted index as a distinct (term, id) table."""
    return tokens.select(term_col, "id").distinct()


def cluster_size_bounds(n: int, min_fraction: float = 0.08, max_fraction: float = 0.2,
                        min_absolute: int = 2) -> tuple[int, int]:
    """AG7: (max(ceil(.08 n), 2), ceil(.2 n))."""
    return max(int(math.ceil(n * min_fraction)), min_absolute), int(math.ceil(n * max_fraction))


def min_samples(n: int, fraction: float = 0.05) -> int:
    """AG8: max(ceil(.05 n), 2)."""
    return max(int(math.ceil(n * fraction)), 2)


def candidate_keywords(post: DataFrame, freq: DataFrame, stop: DataFrame | None, lo: int, hi: int) -> DataFrame:
    """FLT2: terms with lo <= df <= hi, not a stop word, 0 < freq < 1."""
    df = post.groupBy("lemma").agg(F.count(F.lit(1)).alias("size"))
    c = df.where((F.col("size") >= lo) & (F.col("size") <= hi)).join(freq.select("lemma", "freq"), "lemma")
    c = c.where((F.col("freq") > 0) & (F.col("freq") < 1) & (F.col("lemma") != "-PRON-"))
    if stop is not None:
        c = c.join(stop.select("lemma"), "lemma", "left_anti")
    return c


# ------------------------------------------------------------------ VEC3 / VEC4 / VEC5 (A-1)

#: Units (words or characters) whose n-grams a task holds at once; a longer text is taken whole.
GRAM_UNITS = 1 << 16


def _gram_counts(ids: pa.Array, units: pa.Array, lengths: range, glue: str) -> list[pa.Array]:
    """Columns id, term, tf of the distinct n-grams of every row of `units`."""
    at = units.offsets.to_numpy()
    flat, row = units.flatten(), np.repeat(np.arange(len(units)), np.diff(at))
    grams, rows = [], []
    for n in lengths:
        many = max(len(flat) - n + 1, 0)
        inside = row[:many] == row[len(row) - many:]  # the last unit is of the same row
        g = pc.binary_join_element_wise(*(flat.slice(k, many) for k in range(n)), glue) if n > 1 else flat
        grams.append(g.filter(pa.array(inside)))
        rows.append(row[:many][inside])
    coded = pa.concat_arrays(grams).dictionary_encode()
    size = max(len(coded.dictionary), 1)
    key, tf = np.unique(np.concatenate(rows) * size + coded.indices.to_numpy(), return_counts=True)
    return [ids.take(pa.array(key // size)), coded.dictionary.take(pa.array(key % size)), pa.array(tf, pa.int64())]


def gram_frequencies(lists: DataFrame, ngrams: tuple[int, int] = (1, 1), glue: str = " ") -> DataFrame:
    """AG1 of n-grams: lists (id, units ARRAY<STRING>) -> (id, term, tf), the terms being the runs of lo to hi units joined
    by `glue`.  Rows are counted where they are read, so no (id, term) rows are shuffled for it; only the counts
    of ids that occur more than once are added up by a shuffle."""
    from loomtext.session import cut_lineage

    lengths = range(ngrams[0], ngrams[1] + 1)

    def count(batches):
        for batch in batches:
            ids, units = batch.column("id"), batch.column("units")
            at, lo = units.offsets.to_numpy(), 0
            while lo < len(units):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + GRAM_UNITS, "right")) - 1)
                yield pa.RecordBatch.from_arrays(_gram_counts(ids.slice(lo, hi - lo), units.slice(lo, hi - lo), lengths, glue), names=["id", "term", "tf"])
                lo = hi

    rows = lists.select("id", F.coalesce("units", F.array().cast("array<string>")).alias("units"))
    counted = lambda df: df.mapInArrow(count, f"id {lists.schema['id'].dataType.simpleString()}, term string, tf long")
    repeated = cut_lineage(lists.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("id").alias("_id")))
    if not repeated.limit(1).count():
        return counted(rows)
    again, same = broadcast_if_small(repeated), F.col("id").eqNullSafe(F.col("_id"))
    more = counted(rows.join(again, same, "left_semi")).groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    return counted(rows.join(again, same, "left_anti")).unionByName(more)


def with_idf(tf: DataFrame, n_docs: int, max_df: float | None = None, term_col: str = "term") -> DataFrame:
    """(id, term, tf) -> + df, idf = ln((1+n)/(1+df)) + 1 and `first`, true in one row of each term; terms above `max_df`
    are left out.  The counts of a term are brought together once, by one shuffle; a term has a row for a
    document at most, which a window buffers and spills."""
    from pyspark.sql import Window

    w = Window.partitionBy(term_col)
    out = tf.withColumn("first", F.row_number().over(w.orderBy(term_col)) == 1).withColumn("df", F.count(F.lit(1)).over(w))
    if max_df is not None:
        out = out.where(F.col("df") <= F.lit(max_df * n_docs))
    return out.withColumn("idf", smoothed_idf(n_docs))


def smoothed_idf(n_docs: int):
    """ln((1+n)/(1+df)) + 1 of a column df."""
    return F.ln(F.lit(1.0 + n_docs) / (F.col("df") + 1)) + 1


def smoothed_tfidf(terms: DataFrame, sublinear: bool = True, max_df: float | None = None,
                   normalize: bool = True, term_col: str = "term", n_docs: int | None = None) -> DataFrame:
    """A-1 over a long (id, term) table with one row per occurrence, or (id, term, tf) with one row per term:
    idf = ln((1+n)/(1+df)) + 1, w = (1+ln tf)*idf (raw tf when not sublinear), optional
    max_df pruning (FLT3) before weighting, L2 normalisation per document.
    Returns (id, term, tf, df, idf, w)."""
    tf = terms if "tf" in terms.columns else text_frequency(terms, term_col)
    n = n_docs if n_docs is not None else tf.select("id").distinct().count()
    w = with_idf(tf, n, max_df, term_col).select("id", term_col, "tf", "df")
    if normalize:
        w = w.repartition("id")  # counts are sent, weights are computed where they arrive
    raw = (1 + F.ln("tf")) if sublinear else F.col("tf").cast("double")
    w = w.withColumn("idf", smoothed_idf(n)).withColumn("w", raw * F.col("idf"))
    if normalize:
        from pyspark.sql import Window

        # a document's terms form a bounded window partition
        w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))
    return w


def cluster_keyword(docs: DataFrame, stop: DataFrame | None, n_docs: int) -> DataFrame:
    """VEC5: per cluster, the best term of the cluster's joined text under count vectors fitted
    on the corpus: raw tf * smoothed idf, L2-normalised; top 5 by (score, term) descending,
    scores rounded to 3 decimals, first of the highest rounded score.
    docs: (id, text, cluster_id) -> (cluster_id, keyword, score)."""
    from pyspark.sql import Window

    from loomtext.functions import text as T

    toks = F.regexp_extract_all(F.lower(F.col("text")), F.lit(f"[{T.WORD_CHARS}]{{2,}}"), 0)
    tk = docs.select("id", "cluster_id", toks.alias("term"))
    if stop is not None:
        tk = T.without_words(tk, "term", stop.select("lemma"))
    tk = tk.select("id", "cluster_id", F.explode("term").alias("term"))
    df = tk.select("id", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", (F.ln(F.lit(1.0 + n_docs) / (F.col("df") + 1)) + 1).alias("idf"))
    tf = tk.groupBy("cluster_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("cluster_id"))))
    r = w.withColumn("rn", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("w").desc(), F.col("term").desc()))) \
        .where(F.col("rn") <= 5)
    best = r.groupBy("cluster_id").agg(F.min(F.struct((-F.round("w", 3)).alias("ns"), "rn", "term")).alias("b"))
    return best.select("cluster_id", F.col("b.term").alias("keyword"), (-F.col("b.ns")).alias("score"))


def weighted_bag_of_words(tokens: DataFrame, weights: DataFrame, vectors: DataFrame, stop: DataFrame | None = None,
                          power: int = 2, normalize: bool = True) -> DataFrame:
    """VEC1 / VEC2: document vector = sum over tokens of vec(lemma) * w(lemma)^power, stop words
    skipped when `stop` is given, L2-normalised when `normalize` (zero vectors kept).
    tokens (id, lemma) one row per occurrence; weights (id, lemma, w); vectors (lemma, vec).
    Long form (id, dim, x): one partial/final aggregation per (id, dim), no dense matrix."""
    from pyspark.sql import Window

    t = tokens
    if stop is not None:
        t = t.join(broadcast_if_small(stop.select("lemma")), "lemma", "left_anti")
    tf = t.groupBy("id", "lemma").agg(F.count(F.lit(1)).alias("n"))
    x = tf.join(weights.select("id", "lemma", "w"), ["id", "lemma"]).join(vectors, "lemma")
    x = x.select("id", (F.col("n") * F.pow(F.col("w"), power)).alias("c"), F.posexplode("vec").alias("dim", "v"))
    s = x.groupBy("id", "dim").agg(F.sum(F.col("c") * F.col("v")).alias("x"))
    if normalize:
        norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))
        s = s.withColumn("x", F.when(norm > 0, F.col("x") / norm).otherwise(F.col("x")))
    return s


def known_documents(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """FLT1: (id, known) - whether a question has at least one token in the vector vocabulary
    (semi join on the distinct (id, lemma) pairs; removed documents are the `known = false` rows)."""
    from loomtext.functions import text as T

    toks = questions.select("id", F.explode(T.lemmas(T.question_text("question"))).alias("lemma")).distinct()
    hit = toks.join(vocabulary.select("lemma").distinct(), "lemma", "left_semi").select("id").distinct() \
        .withColumn("known", F.lit(True))
    return questions.select("id").join(hit, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))
