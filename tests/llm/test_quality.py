import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.llm import common as C
from loomtext.llm import pu
from helpers import docs, odd_texts

LABELS = "doc_id long, quality int, toxic int"


def _corpus(n=1200):
    rng = random.Random(1)
    out, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 120))]
        junk = i % 5 == 0
        text = " | ".join(w) if junk and i % 2 else "!! ".join(w).upper() if junk else " ".join(w).capitalize() + "."
        out.append((i, text))
        if i % 3 == 0:
            labels.append((i, int(not junk), 0))
    return out, labels


def test_held_out_accuracy(spark):
    given, labels = _corpus()
    got = pu.quality_scores(docs(spark, given), spark.createDataFrame(labels, LABELS), C.fold(F.col("doc_id"), 5) == 0).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum((r.score >= 0.3) == (r.doc_id % 5 > 0) for r in held) >= 0.95 * len(held)
    kept = pu.keep_quality(docs(spark, given), spark.createDataFrame(labels, LABELS), C.fold(F.col("doc_id"), 5) == 0, 0.3)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.score >= 0.3)


def _parts(seen, w, prior, ridge):
    """Plainly: risk of negatives, and values and gradients of the two convex functions whose larger is the risk."""
    t = seen.toArrow()
    x = np.stack([np.frombuffer(b, np.uint8) for b in t["cells"].to_pylist()]).astype(int)
    p = np.array(t["p"].to_pylist(), float)
    full = np.zeros((len(x), pu.WIDTH))
    np.put_along_axis(full, x, 1.0, 1)
    full[:, -1] = 1
    penalty = np.full(pu.WIDTH, ridge)
    penalty[-1] = 1e-6
    z = full @ w
    up, s, share = np.logaddexp(0, z), 1 / (1 + np.exp(-z)), p / p.sum()
    negatives = up.mean() - prior * share @ up
    f = np.array([up.mean() - prior * share @ z, prior * share @ (up - z)]) + penalty @ w**2 / 2
    g = np.stack([full.T @ s / len(x) - prior * full.T @ share, -prior * full.T @ (share * (1 - s))]) + penalty * w
    return negatives, f, g


def test_fit_ends_at_the_minimum_under_the_bound(spark):
    """Far from the bound the gradient of the unbiased risk vanishes; on it, the gradients of both
    functions cancel with weights of 0 to 1, and the risk of negatives is not below zero."""
    given, labels = _corpus(300)
    seen, _ = pu.learn(docs(spark, given), spark.createDataFrame(labels, LABELS), F.lit(False))
    bound = []
    for prior in (0.3, 0.8, 0.95):
        w = pu.fit(seen, prior, ridge=0.01)
        negatives, f, g = _parts(seen, w, prior, 0.01)
        assert negatives >= 0
        bound.append(negatives < 1e-5)
        mix = np.clip(-g[1] @ (g[0] - g[1]) / max((g[0] - g[1]) @ (g[0] - g[1]), 1e-300), 0, 1) if bound[-1] else 1.0
        assert np.abs(mix * g[0] + (1 - mix) * g[1]).max() < 1e-5
        rng = np.random.default_rng(0)
        for size in (1e-3, 1e-2, 0.1):  # nothing near is better
            other = _parts(seen, w + size * rng.normal(size=pu.WIDTH), prior, 0.01)
            assert other[1].max() >= f.max() - 2e-6
        again = pu.fit(seen, prior, ridge=0.01, start=w)
        assert np.abs(again - w).max() < 1e-4
    assert bound[0] is np.False_ and bound[-1] is np.True_


def test_an_unsettled_fit_is_an_error(spark):
    given, labels = _corpus(60)
    seen, _ = pu.learn(docs(spark, given), spark.createDataFrame(labels, LABELS), F.lit(False))
    with pytest.raises(RuntimeError, match="not settled"):
        pu.fit(seen, 0.8, passes=2)


def test_prior_is_read_from_positives_and_unlabelled_text(spark):
    given, labels = _corpus()  # four of five texts are clean, labels of class 0 are not looked at
    positive = [(i, q, t) for i, q, t in labels if q]
    seen, w = pu.learn(docs(spark, given), spark.createDataFrame(positive, LABELS), F.lit(False))
    assert abs(pu.prior_of_scores(seen, w) - 0.8) < 0.05 and pu.prior_of_indicators(seen) >= 0.78
    other, w2 = pu.learn(docs(spark, given), spark.createDataFrame(labels, LABELS), F.lit(False))
    assert np.abs(w - w2).max() < 1e-6


def test_odd_texts_and_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, None, 1), (None, 0, 1), (3, 7, 0), (4, 0, 0)], LABELS)
    given = odd_texts()
    for labels in (none, odd):
        got = pu.quality_scores(docs(spark, given), labels, C.fold(F.col("doc_id"), 5) == 0).collect()
        assert len(got) == len(given) and all(0 <= r.score <= 1 for r in got)
        assert pu.quality_scores(docs(spark, []), labels, F.lit(False)).count() == 0
    kept = pu.keep_quality(docs(spark, given), odd, F.lit(False), 0.0)
    assert kept.columns == docs(spark, given).columns and kept.count() == len(given)


def test_cells_stay_in_their_feature():
    x = pu.cells(pa.array([t or "" for _, t, *_ in odd_texts()]))
    assert (x >= pu.FIRST).all() and (x < pu.FIRST + np.array(pu.CELLS)).all()
