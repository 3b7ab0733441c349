"""Quality rules by robust multivariate outliers (minimum covariance determinant).

Every text gives a vector of transformed statistics.  Within each (language, source) the location
and scatter of the most concentrated `share` of the vectors are estimated: concentration steps start
from coordinate medians and median deviations (a deterministic start) and repeat mean, covariance
and selection of the nearest vectors, each group until its determinant falls no further (a group that
is done takes no part in later steps, and keeps its smallest determinant); one reweighting step follows.  A
document is rejected when its squared Mahalanobis distance exceeds the chi-square `quantile`.

Each step is an aggregation over the statistics table: moments per group, then a histogram of the
logarithm of the distances whose cumulative counts give the cut.  No group meets in one task, and
the selection (whole histogram cells) does not depend on partitioning.  Groups with fewer than
`min_rows` documents are pooled by language, and languages still below that with each other.  Each
coordinate's variance has the floor `FLOOR`^2, since clean texts agree exactly in some statistics.

Null texts have no words; texts without words fail the base rule and enter no estimate.  Null
languages and sources are groups of their own.  Repeated rows count row by row.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm import common as C
from loomtext.llm import textstats as S
from loomtext.session import cut_lineage

NAMES = ["size", "word_length", "symbols", "dup_lines", "repeats", "upper", "variety"]
D = len(NAMES)
FLOOR = 0.1
#: Cells of the histograms: per unit of a coordinate, and per unit of the logarithm of a distance.
CELLS, LOG_CELLS = 64, 32
#: A concentration step that lowers the logarithm of a group's determinant by no more than this is its last.
LEAST_FALL = 1e-6
ROW = ("doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
       "n_repeat_words long, x array<double>")


def transform(s: dict[str, np.ndarray]) -> np.ndarray:
    """Statistics to coordinates whose bulk is close to normal; [documents, D]."""
    n = np.maximum(s["n_words"], 1).astype(float)
    chars = np.maximum(s["word_chars"], 1)
    return np.stack([
        np.log(n) / 2, 2 * np.log(chars / n), np.log((s["n_symbols"] + 0.2) / (n + 20)) / 4,
        s["n_dup_lines"] / (s["n_lines"] + 2), s["n_repeat_words"] / (n + 20),
        2 * np.sqrt(s["n_upper"] / chars), np.log(np.maximum(s["n_distinct"], 1)) / np.log(n + 10) * 2], 1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        s = S.statistics(C.utf8(C.column(batch, "text")))
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        yield pa.RecordBatch.from_arrays(
            [C.column(batch, "doc_id"), C.column(batch, "lang"), C.column(batch, "source"),
             *(pa.array(s[k].astype(np.int64)) for k in names), pa.array(list(transform(s)), pa.list_(pa.float64()))],
            names=["doc_id", "lang", "source", *names, "x"])


def statistics(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(_rows, ROW)


# ------------------------------------------------------------------ chi-square
def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > 1e-16 * total:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(d / 2, mid / 2) < p else (lo, mid)
    return hi


def consistency(share: float, d: int) -> float:
    """Factor that makes the scatter of the nearest `share` unbiased for normal data."""
    return share / gamma_p(d / 2 + 1, chi2_quantile(share, d) / 2)


# ------------------------------------------------------------------ concentration steps
def _cut(cells: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, cell, n) -> (keys, cut): the first cell at which the counts reach `share` of all."""
    w = Window.partitionBy(*keys)
    run = cells.withColumn("upto", F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("all", F.sum("n").over(w))
    return run.where(F.col("upto") >= F.ceil(F.lit(share) * F.col("all"))).groupBy(*keys).agg(F.min("cell").alias("cut"))


def _medians(x: DataFrame) -> DataFrame:
    """(g, i, v) -> (g, i, med): coordinate medians to the width of a cell."""
    cells = x.groupBy("g", "i", F.floor(F.col("v") * CELLS).alias("cell")).agg(F.count("*").alias("n"))
    return _cut(cells, ["g", "i"], 0.5).select("g", "i", ((F.col("cut") + 0.5) / CELLS).alias("med"))


def _estimate(factor: float):
    """Moments about the previous centre -> centre, inverse scatter and log determinant of each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = C.column(b, "n").to_numpy(zero_copy_only=False).astype(float)
            m = np.array(C.column(b, "m").to_pylist(), float).reshape(-1, D)
            s1 = np.stack([C.column(b, f"s{i}").to_numpy(zero_copy_only=False) for i in range(D)], 1) / n[:, None]
            cov = np.zeros((len(n), D, D))
            for i in range(D):
                for j in range(i, D):
                    cov[:, i, j] = cov[:, j, i] = C.column(b, f"s{i}_{j}").to_numpy(zero_copy_only=False) / n - s1[:, i] * s1[:, j]
            cov = cov * factor + np.eye(D) * FLOOR ** 2
            yield pa.RecordBatch.from_arrays(
                [C.column(b, "g"), pa.array(list(m + s1), pa.list_(pa.float64())),
                 pa.array(list(np.linalg.inv(cov).reshape(len(n), -1)), pa.list_(pa.float64())),
                 pa.array(np.round(np.linalg.slogdet(cov)[1], 6))], names=["g", "m", "inv", "logdet"])
    return run


FIT = "g string, m array<double>, inv array<double>, logdet double"


def _distance() -> Column:
    c = [F.col("x")[i] - F.col("m")[i] for i in range(D)]
    total = F.lit(0.0)
    for i in range(D):
        for j in range(i, D):
            total = total + (1 if i == j else 2) * F.col("inv")[i * D + j] * c[i] * c[j]
    return F.greatest(total, F.lit(1e-9))


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """(g, x, m) of the selected vectors -> fit."""
    c = [F.col("x")[i] - F.col("m")[i] for i in range(D)]
    sums = [F.sum(c[i]).alias(f"s{i}") for i in range(D)]
    sums += [F.sum(c[i] * c[j]).alias(f"s{i}_{j}") for i in range(D) for j in range(i, D)]
    got = rows.groupBy("g").agg(F.count("*").alias("n"), F.first("m").alias("m"), *sums)
    return cut_lineage(got.mapInArrow(_estimate(factor), FIT))


def _nearest(rows: DataFrame, share: float) -> DataFrame:
    """Rows (g, x, m, inv) within the nearest `share` of their group."""
    rows = rows.withColumn("cell", F.floor(F.log(_distance()) * LOG_CELLS))
    cut = C.materialise(_cut(rows.groupBy("g", "cell").agg(F.count("*").alias("n")), ["g"], share))
    return C.join_small(rows, cut, "g").where("cell <= cut")


def fit(x: DataFrame, share: float = 0.75) -> DataFrame:
    """(g, x) -> robust centre and inverse scatter of every group."""
    long_ = x.select("g", F.posexplode("x").alias("i", "v"))
    med = C.materialise(_medians(long_))
    mad = _medians(C.join_small(long_, med, ["g", "i"]).select("g", "i", F.abs(F.col("v") - F.col("med")).alias("v")))
    start = med.join(mad.withColumnRenamed("med", "mad"), ["g", "i"]).groupBy("g").agg(
        F.sort_array(F.collect_list(F.struct("i", "med", "mad"))).alias("c"))
    scale = F.transform("c", lambda e: 1 / F.pow(F.greatest(1.4826 * e["mad"], F.lit(FLOOR)), F.lit(2.0)))
    diagonal = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(D - 1)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(D - 1)), lambda j: F.when(i == j, F.element_at(scale, (i + 1).cast("int"))).otherwise(0.0))))
    active = cut_lineage(start.select("g", F.transform("c", lambda e: e["med"]).alias("m"), diagonal.alias("inv"), F.lit(float("inf")).alias("logdet")))
    settled = []
    while True:  # determinants fall by a least amount in each step and are bounded by FLOOR: this ends
        step = _moments(_nearest(C.join_small(x, active, "g", "inner"), share), consistency(share, D))
        falls = F.col("n.logdet") < F.col("a.logdet") - LEAST_FALL
        both = active.alias("a").join(step.alias("n"), F.col("a.g") == F.col("n.g"), "left").select(
            F.struct("a.*").alias("old"), F.struct("n.*").alias("new"), F.coalesce(falls, F.lit(False)).alias("falls"))
        both = cut_lineage(both)
        settled.append(both.where("not falls").select("old.*"))
        active = both.where("falls").select("new.*")
        if not active.limit(1).count():
            break
    state = cut_lineage(reduce(DataFrame.union, settled))
    near = C.join_small(x, state, "g").where(_distance() <= chi2_quantile(0.975, D))
    again = _moments(near, consistency(0.975, D))
    return state.join(again.select("g", F.col("m").alias("m2"), F.col("inv").alias("inv2")), "g", "left").select(
        "g", F.coalesce("m2", "m").alias("m"), F.coalesce("inv2", "inv").alias("inv"))


def quality_rules(docs: DataFrame, quantile: float = 0.99999, share: float = 0.75, min_rows: int = 200) -> DataFrame:
    """(doc_id, lang, source, text) -> statistics, base_failed, distance (squared), kept."""
    rows = C.materialise(statistics(docs))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = rows.withColumn("lang_key", key("lang")).withColumn("source_key", key("source"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    sizes = rows.where("n_words > 0").groupBy("lang_key", "source_key").agg(F.count("*").alias("n"))
    small = Window.partitionBy("lang_key")
    pooled = F.sum(F.when(F.col("n") < min_rows, F.col("n")).otherwise(0)).over(small)
    name = (F.when(F.col("n") >= min_rows, F.concat_ws("\t", "lang_key", "source_key"))
            .when(pooled >= min_rows, F.col("lang_key")).otherwise(F.lit("")))
    named = C.materialise(sizes.select("lang_key", "source_key", name.alias("g")))
    grouped = C.join_small(rows, named, ["lang_key", "source_key"])
    fitted = C.materialise(fit(grouped.where("n_words > 0").select("g", "x"), share))
    out = C.join_small(grouped, fitted, "g").withColumn("distance", F.when(F.col("n_words") > 0, _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(quantile, D), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      kept.alias("kept"), "distance")
