"""What a task holds at once does not grow with the rows that it gets."""
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.operators import cells as C
from loomtext.operators import pairs as PR
from loomtext.operators import wordpairs as WP


class _Stop(Exception):
    pass


def _taken(monkeypatch, name, at):
    """The function that is handed to `cells.<name>` as argument `at`."""
    got = []

    def take(*args):
        got.append(args[at])
        raise _Stop
    monkeypatch.setattr(C, name, take)
    return got


def _frame(n, dims=64, first=0):
    v = np.random.default_rng(first).normal(size=(n, dims))
    return pd.DataFrame({"corpus": 0, "id": np.arange(first, first + n), "n": 1, "ids": [np.array([i]) for i in range(first, first + n)], "vec": list(v)})


def test_queries_of_a_tile_are_compared_in_slices(spark, monkeypatch):
    points = spark.createDataFrame([(0, 1, [0.0, 1.0]), (0, 2, [1.0, 1.0])], "corpus long, id long, vec array<double>")
    got = _taken(monkeypatch, "meet_own", 1)
    with pytest.raises(_Stop):
        C.knn(points, 5, "minkowski:1.5")
    q, m = _frame(1024, first=5000), _frame(512)
    tracemalloc.start()
    out = got[0](q, m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20  # 1024 x 512 distances and their copies were held at once
    D = PR.minkowski(PR.mat(q), PR.mat(m), 1.5)
    best = np.argsort(D, axis=1, kind="stable")[:, :6]
    assert out["nb_id"].to_numpy().reshape(-1, 6).tolist() == best.tolist()


def test_visits_leave_in_slices(spark, monkeypatch):
    points = spark.createDataFrame([(0, i, [float(i), 1.0]) for i in range(20)], "corpus long, id long, vec array<double>")
    index = C.build(points, "euclidean")
    got = _taken(monkeypatch, "_with_cells", 2)
    with pytest.raises(_Stop):
        C.visits(index, points)
    q = _frame(3000).assign(bound=np.inf, own_cell=-1, own_tile=0)
    cells = _frame(10, first=9000).rename(columns={"id": "cell"}).assign(radius=1.0, tiles=3)
    sizes = [len(f) for f in got[0](q, cells)]
    assert sum(sizes) == 3000 * 30 and max(sizes) <= C.VISITS


def test_k_smallest_with_ties_and_without_numbers():
    rng = np.random.default_rng(2)
    a = pd.DataFrame({"id": rng.permutation(30)})
    b = pd.DataFrame({"id": 100 + rng.permutation(40)})
    D = rng.integers(0, 6, (30, 40)).astype(float)
    D[rng.random(D.shape) < 0.5] = np.nan
    D[3], D[4, 5:] = np.nan, np.inf
    got = PR._smallest(a, b, False, D, 7, "d")
    for ids, others, M in ((a["id"], b["id"], D), (b["id"], a["id"], D.T)):
        for i, row in zip(ids, M):
            want = sorted((x, j) for x, j in zip(row, others) if np.isfinite(x))[:7]
            mine = got[got["id"] == i]
            assert list(zip(mine["d"], mine["nb_id"])) == want


def test_blocks_are_large_enough_to_bound_the_copies(spark):
    points = spark.range(3000).selectExpr("0L AS corpus", "id", "array(cast(id as double)) AS vec")
    assert PR.replicate(PR.blocked(points)).count() <= 3000 * 3


def test_silhouette_sums_of_several_cuts(spark):
    rng = np.random.default_rng(4)
    X, labels = rng.normal(size=(30, 3)), rng.integers(0, 4, (30, 2))
    pts = spark.createDataFrame([(0, i, X[i].tolist(), labels[i].tolist()) for i in range(30)],
                                "corpus long, id long, vec array<double>, labels array<int>")
    got = PR.silhouette_sums(pts, block_rows=8).groupBy("id", "cut", "label").sum("dsum", "cnt").collect()
    D = PR.euclidean(X, X)
    np.fill_diagonal(D, 0)
    assert len(got) == sum(len(np.unique(labels[:, c])) for c in (0, 1)) * 30
    for r in got:
        mine = labels[:, r["cut"]] == r["label"]
        assert abs(r["sum(dsum)"] - D[r["id"], mine].sum()) < 1e-6 and r["sum(cnt)"] == mine.sum() - mine[r["id"]]


def test_similar_words_sends_a_word_to_few_blocks(spark, monkeypatch):
    """Blocks of 1,024 words sent each word to as many blocks as there are thousands of words."""
    sent, replicate = [], PR.replicate
    monkeypatch.setattr(PR, "replicate", lambda pts: sent.append(replicate(pts)) or sent[-1])
    words = spark.range(40_000).select(F.concat(F.lit("w"), "id").alias("lemma"), F.array(F.sin("id"), F.cos("id")).alias("vec"))
    WP.similar_words(words, "cosine", 2.0)
    assert sent[0].count() == WP.SIMILAR_BLOCKS * 40_000


def test_similar_words_in_strips_and_tiles(spark, monkeypatch):
    words = [(f"w{i % 50:02d}", [float(i % 7), float(i % 5)]) for i in range(60)]
    table = spark.createDataFrame(words, "lemma string, vec array<double>").repartition(3)
    want = sorted((a, b) for a, u in words for b, v in words if a != b and any(u) and any(v)
                  and abs(np.dot(u, v)) / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.9)
    for strip, tile in ((3, 4), (64, 1024)):
        monkeypatch.setattr(WP, "STRIP", strip)
        monkeypatch.setattr(WP, "TILE", tile)
        assert sorted((r.lemma, r.other) for r in WP.similar_words(table, "cosine", 0.9).collect()) == want
