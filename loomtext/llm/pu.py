"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled rows of class 1 in the learning folds; every document counts as
unlabelled web text.  With the logistic loss l(z) = log(1 + exp(-z)) and class prior p the unbiased
risk is

    p mean_P[l(z)]  +  (mean_U[l(-z)] - p mean_P[l(-z)])

whose second part, the risk of negatives, must not fall below zero; the non-negative risk puts zero
in its place where it would.  A text is described by shares and sizes (words, symbols, lines,
repetitions, case, punctuation), each cut at fixed bounds into indicator features.

The class prior is estimated from positives and unlabelled text: whatever set S of texts is looked
at, U(S) >= p P(S), so p is at most U(S) / P(S), and the ratio is read where its upper confidence
limit is lowest.  The indicators that a tenth of the positives have are the first sets; a fit with
their value ranks all texts, and the texts above each bound of its score are the sets that give the
prior of the final fit.

The fit.  The non-negative risk is the larger of two convex functions of the weights,
f1 = mean_U[l(-z)] - p mean_P[z] and f2 = p mean_P[l(z)] (their difference is the risk of negatives),
so it is convex itself.  Each step minimises the larger of their linear models plus a shared
quadratic one (a Newton step with one multiplier) and is halved until the risk falls; the fit ends
where no step of any size is left, at the minimum of f1 or on the bound, and raises an error if it does
not get there.  Each pass aggregates values, gradients and Hessians over all documents in the tasks;
Spark adds them up.

Null and empty texts have their own indicators and get a score like any other.  Labels that are
null or not 0/1 are ignored, a document labelled more than once counts once per label row; repeated
documents count row by row.  Without positives all weights are zero and all scores are 0.5.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm import common as C
from loomtext.llm import textstats as S

SHARES = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.75])
#: Features in order: (name, bounds of its cells).
FEATURES = [
    ("log_words", np.arange(0.5, 10.5, 1.0)), ("word_length", np.array([2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 9.0])),
    ("symbols", SHARES), ("pipes", SHARES), ("bangs", SHARES), ("digits", SHARES), ("stops", SHARES), ("upper", SHARES),
    ("adjacent", SHARES), ("top_word", SHARES), ("dup_lines", SHARES), ("repeats", SHARES),
    ("variety", np.array([0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])), ("words_per_line", np.array([2, 4, 8, 16, 32, 64, 128.0])),
]
CELLS = [len(bounds) + 1 for _, bounds in FEATURES]
FIRST = np.cumsum([0, *CELLS[:-1]])
WIDTH = sum(CELLS) + 1  # the last is the constant
ROWS = 4 + 2 * WIDTH  # of the sums of a pass
#: Cells of the histogram of linear scores, per unit.
SCORE_CELLS = 20
#: Share of the positives that a set has at least from which the prior is read (indicators; bounds of a score).
LEAST_SHARE, LEAST_ABOVE = 0.1, 0.5
#: The risk of negatives is kept this far above zero, so that rounding does not take it below.
MARGIN = 1e-6


def cells(text: pa.Array) -> np.ndarray:
    """[documents, features]: the number of the indicator that each feature sets."""
    s = S.statistics(text)
    n, chars = np.maximum(s["n_words"], 1).astype(float), np.maximum(s["word_chars"], 1).astype(float)
    values = {
        "log_words": np.log(n) * (s["n_words"] > 0), "word_length": s["word_chars"] / n, "symbols": s["n_symbols"] / n,
        "pipes": s["n_pipes"] / n, "bangs": s["n_bangs"] / n, "digits": s["n_digits"] / chars, "stops": s["n_stops"] / n,
        "upper": s["n_upper"] / chars, "adjacent": s["n_adjacent"] / n, "top_word": s["n_top"] / n * (s["n_words"] > 10),
        "dup_lines": s["n_dup_lines"] / np.maximum(s["n_lines"], 1), "repeats": s["n_repeat_words"] / n,
        "variety": np.log(np.maximum(s["n_distinct"], 1)) / np.log(n + 1), "words_per_line": n / np.maximum(s["n_lines"], 1),
    }
    return np.stack([FIRST[i] + np.searchsorted(bounds, values[name], "right") for i, (name, bounds) in enumerate(FEATURES)], 1)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        x = cells(C.utf8(C.column(batch, "text"))).astype(np.uint8)
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(C.column(batch, n) for n in rest), pa.array([r.tobytes() for r in x], pa.binary())],
                                         names=[*rest, "cells"])


def _indicators(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(C.column(batch, "cells").to_pylist()), np.uint8).reshape(-1, len(FEATURES)).astype(np.int64)


def _sums(w: np.ndarray):
    """Sums over all rows (unlabelled) and over those with weight p (trusted positives): risks, gradients, Hessians."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ROWS, WIDTH))
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x = _indicators(part)
                p = C.column(part, "p").to_numpy(zero_copy_only=False).astype(float)
                full = np.zeros((len(x), WIDTH))
                np.put_along_axis(full, x, 1.0, 1)
                full[:, -1] = 1
                z = full @ w
                up, s = np.logaddexp(0, z), 1 / (1 + np.exp(-z))
                total[0, :4] += [len(x), p.sum(), up.sum(), p @ up]
                total[0, 4] += p @ z
                total[1] += full.T @ s
                total[2] += full.T @ p
                total[4:4 + WIDTH] += (full * (s * (1 - s))[:, None]).T @ full
                if p.any():
                    full, s, p = full[p > 0], s[p > 0], p[p > 0]
                    total[3] += full.T @ (p * s)
                    total[4 + WIDTH:] += (full * (p * s * (1 - s))[:, None]).T @ full
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["i", "v"])
    return run


def _evaluate(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    got = (rows.mapInArrow(_sums(w), "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
           .groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow())  # ROWS x WIDTH numbers
    total = np.zeros((ROWS, WIDTH))
    total[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
    return total


def _tightest(u: np.ndarray, p: np.ndarray, n: float, positives: float, least: float) -> float:
    """U(S) / P(S) of the set whose upper confidence limit is lowest, among sets with enough positives."""
    often = (p >= least) & (u > 0)
    u, p = u[often], p[often]
    error = u / p * np.sqrt(np.maximum(1 - p, 0) / (p * positives) + np.maximum(1 - u, 0) / (u * n))
    return float(np.clip((u / p)[np.argmin(u / p + 2 * error)], 0.01, 0.99))


def prior_of_indicators(rows: DataFrame) -> float:
    """A first, upper value of the prior: the sets are the indicators.  0.5 if there is nothing to read."""
    t = _evaluate(rows, np.zeros(WIDTH))
    n, positives = t[0, 0], t[0, 1]
    # at zero weights every row's probability is a half
    return _tightest(2 * t[1, :-1] / n, t[2, :-1] / positives, n, positives, LEAST_SHARE) if n and positives else 0.5


def _histogram(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = w[_indicators(b)].sum(1) + w[-1]
            cell, at = np.unique(np.floor(z * SCORE_CELLS).astype(np.int64), return_inverse=True)
            p = np.bincount(at, C.column(b, "p").to_numpy(zero_copy_only=False).astype(float), len(cell))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.bincount(at, minlength=len(cell)).astype(float)), pa.array(p)], names=["cell", "u", "p"])
    return run


def prior_of_scores(rows: DataFrame, w: np.ndarray) -> float:
    """The prior read from the sets of rows whose linear score reaches a bound; 0.5 without positives."""
    got = rows.mapInArrow(_histogram(w), "cell long, u double, p double").groupBy("cell").agg(F.sum("u").alias("u"), F.sum("p").alias("p"))
    got = got.orderBy(F.desc("cell")).toArrow()  # as many rows as cells
    u, p = (np.cumsum(got[c].to_numpy()) for c in "up")
    return _tightest(u / u[-1], p / p[-1], u[-1], p[-1], LEAST_ABOVE) if len(u) and p[-1] else 0.5


def risk_of_negatives(t: np.ndarray, prior: float) -> float:
    return t[0, 2] / t[0, 0] - prior * t[0, 3] / t[0, 1]


def fit(rows: DataFrame, prior: float, ridge: float = 5e-4, start: np.ndarray | None = None, tolerance: float = 1e-7,
        passes: int = 200) -> np.ndarray:
    """Weights that minimise the non-negative risk over (cells, p)."""
    penalty = np.full(WIDTH, ridge)
    penalty[-1] = 1e-6

    def parts(w: np.ndarray, t: np.ndarray):
        """Values, gradients and Hessians of f1 and f2."""
        n, m, square = t[0, 0], t[0, 1], penalty @ w**2 / 2
        f = np.array([t[0, 2] / n - prior * t[0, 4] / m + square, prior * (t[0, 3] - t[0, 4]) / m + square + MARGIN])
        g = np.stack([t[1] / n - prior * t[2] / m, prior * (t[3] - t[2]) / m]) + penalty * w
        return f, g, np.stack([t[4:4 + WIDTH] / n, prior * t[4 + WIDTH:] / m]) + np.diag(penalty)

    w, mix, used = np.zeros(WIDTH) if start is None else start, 1.0, 1
    t = _evaluate(rows, w)
    if not t[0, 0] or not t[0, 1]:
        return np.zeros(WIDTH)
    while True:
        f, g, h = parts(w, t)
        for _ in range(50):  # the multiplier that weighs the two Hessians is the one they give
            a = np.linalg.solve(mix * h[0] + (1 - mix) * h[1], np.stack([g[1], g[0] - g[1]], 1))
            tilt = (f[0] - f[1] - (g[0] - g[1]) @ a[:, 0]) / max((g[0] - g[1]) @ a[:, 1], 1e-300)
            last, mix = mix, float(np.clip(tilt, 0, 1)) * 0.5 + mix * 0.5
            if abs(mix - last) < 1e-12:
                break
        step = -(a[:, 0] + mix * a[:, 1])
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))
        gain = f.max() - (f + g @ step).max()  # of the linear models
        if np.abs(step).max() < tolerance or gain < 1e-13:
            return w
        while True:
            used += 1
            if used > passes:
                raise RuntimeError(f"the risk has not settled after {passes} passes")
            t = _evaluate(rows, w + step)
            if parts(w + step, t)[0].max() <= f.max() - 1e-4 * gain or np.abs(step).max() < tolerance:
                break
            step, gain = step / 2, gain / 2
        w = w + step


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(w[x].sum(1) + w[-1])))


def _scores(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([C.column(b, "doc_id"), C.column(b, "held_out"), pa.array(probability(_indicators(b), w))],
                                             names=["doc_id", "held_out", "score"])
    return run


def learn(docs: DataFrame, labels: DataFrame, held: Column, max_labelled: int = 200_000) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, held_out, cells) of every document, and the fitted weights.  Labels count only where
    `held` (an expression over doc_id) is false.  Beyond `max_labelled` label rows, positives are the
    rows of lowest hash in about that number; unlabelled text is never sampled."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"), held.alias("h"))
    known = C.materialise(labels.where("not h and q in (0, 1)"))
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_labelled / max(n, 1)))
    positive = C.materialise(known.where(share & (F.col("q") == 1)).groupBy("doc_id").agg(F.count("*").alias("p")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    seen = rows.mapInArrow(_cells, "doc_id long, held_out boolean, cells binary")
    seen = C.materialise(C.join_small(seen, positive, "doc_id").withColumn("p", F.coalesce("p", F.lit(0))))
    first = fit(seen, prior_of_indicators(seen))
    return seen, fit(seen, prior_of_scores(seen, first), start=first)


def quality_scores(docs: DataFrame, labels: DataFrame, held: Column, **bounds) -> DataFrame:
    """(doc_id, text), (doc_id, quality) -> (doc_id, held_out, score)."""
    seen, w = learn(docs, labels, held, **bounds)
    return seen.mapInArrow(_scores(w), "doc_id long, held_out boolean, score double")


def keep_quality(docs: DataFrame, labels: DataFrame, held: Column, threshold: float, **bounds) -> DataFrame:
    """Rows of `docs`, all columns, whose score reaches the threshold (scored in one pass, row by row)."""
    _, w = learn(docs, labels, held, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            yield batch.filter(pa.array(probability(cells(C.utf8(C.column(batch, "text"))), w) >= threshold))
    return docs.mapInArrow(run, docs.schema)
