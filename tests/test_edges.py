"""Cases that must not depend on size, ties, repeated ids or degenerate values."""
import math
import uuid

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import labels as LB
from loomtext.operators import match as MT
from loomtext.operators import sparsify as SP
from loomtext.operators import ward as WD
from loomtext.operators.quantile import exact_quantile
from loomtext.plans import pipelines as PL
from loomtext.streaming import stream_match as ST
from loomtext.session import ensure_checkpoint_dir


def _points(spark, vectors, corpus=0):
    return spark.createDataFrame([(corpus, i, [float(x) for x in v]) for i, v in enumerate(vectors)], "corpus long, id long, vec array<double>")


def test_identical_vectors_keep_their_pairs(spark):
    """No row varies: every key is 0, and the first 16 pairs by (i, j) survive (k = 4, type 2)."""
    kept = SP.kept_pairs(_points(spark, [[0.3, 0.4, 0.5]] * 8), k=4, type_n=2).orderBy("i", "j").collect()
    assert len(kept) == 16 and [(r.i, r.j) for r in kept[:8]] == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (0, 6), (0, 7), (1, 2)]
    assert SP._sparse_matrix_np(np.tile([0.3, 0.4, 0.5], (8, 1)), 4, 2).shape == (8, 8)


@pytest.mark.parametrize("k", [4, 5, 6, 7])
def test_tied_heights_give_exactly_k_clusters(spark, k):
    """Four pairs at the same distance, far from each other."""
    vectors = [[100.0 * (i // 2), float(i % 2)] for i in range(8)]
    for label in (WD.ward_k(_points(spark, vectors), k), WD.ward_k_distributed(_points(spark, vectors), k)):
        rows = {r.id: r.label for r in label.collect()}
        assert len(set(rows.values())) == k
        # ties are merged in order of the smaller member
        assert sum(rows[2 * i] == rows[2 * i + 1] for i in range(4)) == 8 - k
        assert all(rows[2 * i] == rows[2 * i + 1] for i in range(8 - k))


def test_corpora_of_few_points_keep_their_rows(spark):
    """k = n and k > n give one cluster for each point; without a candidate k the best k is the size."""
    rng = np.random.default_rng(5)
    sizes = {0: 1, 1: 3, 2: 4, 3: 5, 4: 9}
    rows = [(c, 10 * c + i, rng.normal(size=3).tolist()) for c, n in sizes.items() for i in range(n)]
    points = spark.createDataFrame(rows, "corpus long, id long, vec array<double>")
    for out in (WD.ward_k(points, 4), WD.ward_k_distributed(points, 4)):
        got = {}
        for r in out.collect():
            got.setdefault(r.corpus, {})[r.id] = r.label
        assert {c: len(x) for c, x in got.items()} == sizes
        assert all(len(set(x.values())) == min(4, sizes[c]) for c, x in got.items())
        assert [got[1][10 + i] for i in range(3)] == [0, 1, 2]
    for out in (SP.best_k_normal(points), SP.best_k_sparse(points), SP.route_best_k(points)):
        got = {}
        for r in out.collect():
            got.setdefault(r.corpus, []).append(r)
        assert {c: len(x) for c, x in got.items()} == sizes
        for c, x in got.items():
            assert len({r.label for r in x}) == x[0].k == (sizes[c] if sizes[c] <= 4 else x[0].k)
            assert all((r.score is None) == (sizes[c] <= 4) for r in x)


def test_repeated_ids_are_rows_of_their_own(spark):
    q = spark.createDataFrame([(1, "red fox"), (1, "blue sky"), (2, "nothing here")], "id long, question string")
    kw = spark.createDataFrame([("fox",), ("sky",)], "keyword string")
    freq = spark.createDataFrame([("fox", 0.1), ("sky", 0.2)], "lemma string, freq double")
    for method in ("array", "join"):
        got = sorted(map(tuple, MT.match_categories(q, kw, freq, method=method).collect()))
        assert got == [(1, "fox"), (1, "sky"), (2, "uncategorized")]


def test_streams_take_long_keyword_lists(spark):
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/long-{uuid.uuid4().hex}"
    words = [f"w{i}" for i in range(400)]
    spark.createDataFrame([(i, f"say w{i} and w{i + 1}") for i in range(399)], "id long, question string").write.parquet(base + "/in")
    kw = spark.createDataFrame([(w,) for w in words], "keyword string")
    freq = spark.createDataFrame([(w, 1.0 / (i + 2)) for i, w in enumerate(words)], "lemma string, freq double")
    out = ST.run_available_now(spark, base + "/in", "id long, question string", kw, freq, base + "/out", base + "/state")
    assert {r.id: r.label for r in out.collect()} == {i: f"w{i + 1}" for i in range(399)}


def test_quantiles_with_infinite_and_nan_values(spark):
    rows = [("plain", float(i)) for i in range(301)] + [("inf", float(i)) for i in range(300)] + [("inf", math.inf)] * 3
    rows += [("nan", float(i)) for i in range(300)] + [("nan", math.nan)] + [("low", -math.inf)] * 200 + [("low", 1.0)] * 101
    df = spark.createDataFrame(rows, "g string, v double")
    q = {r.g: r.quantile for r in exact_quantile(df, ["g"], "v", 0.5, collect_max=50).collect()}
    assert q == {"plain": 150.0, "inf": 151.0, "nan": 150.0, "low": -math.inf}
    top = {r.g: r.quantile for r in exact_quantile(df, ["g"], "v", 1.0, collect_max=50).collect()}
    assert top["plain"] == 300.0 and top["inf"] == math.inf and math.isnan(top["nan"]) and top["low"] == 1.0


def test_labels_keep_to_their_corpus(spark):
    q = spark.createDataFrame([("A", 1, "red fox"), ("A", 2, "red hen"), ("B", 1, "blue sky"), ("B", 2, "blue sea")],
                              "corpus string, id long, question string")
    m = q.select("corpus", "id", F.lit(0).alias("cluster_id"))
    got = {r.corpus: set(" ".join(r.labels).split()) for r in LB.cluster_labels(q, m, PL.encode(q)).collect()}
    assert got["A"] <= {"RED", "FOX", "HEN"} and got["B"] <= {"BLUE", "SKY", "SEA"} and got["A"] and got["B"]


def test_label_scores_equal_plain_ones(spark, monkeypatch):
    """Small blocks, ties between terms of equal vectors: same scores, ties by gram."""
    monkeypatch.setattr(LB, "TERM_BLOCK", 5)
    monkeypatch.setattr(LB, "CLUSTER_BLOCK", 2)
    rng = np.random.default_rng(0)
    vec = {f"t{i:02d}": rng.integers(0, 3, 2).astype(float).tolist() for i in range(24)}
    cent = {c: rng.random(2).tolist() for c in range(5)}
    nm = [(0, c, g, float(rng.integers(0, 3)) / 4) for c in cent for g in list(vec)[::3]]
    got = LB.label_scores_by_corpus(
        spark.createDataFrame(nm, "corpus long, cluster_id long, gram string, nmi double"),
        spark.createDataFrame([(0, g, v) for g, v in vec.items()], "corpus long, gram string, vec array<double>"),
        spark.createDataFrame([(0, c, v) for c, v in cent.items()], "corpus long, cluster_id long, centroid array<double>")).collect()
    for c, v in cent.items():
        d = {g: math.dist(v, x) for g, x in vec.items()}
        own = {g: x for _, k, g, x in nm if k == c}
        scale = 0.5 * max(max(own.values()), 0.0) * min(d.values())
        want = sorted(((round(own.get(g, 0.0) + (scale / d[g] if d[g] > 0 else scale), 9), g) for g in vec), key=lambda x: (-x[0], x[1]))[:5]
        mine = sorted((r for r in got if r.cluster_id == c), key=lambda r: r["rank"])
        assert [(round(r.score, 9), r.label) for r in mine] == want


def test_stop_words_by_set_and_by_join(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["a", "b", "a", "c"]), (1, ["b"]), (2, []), (3, ["c", "d"])], "id long, w array<string>")
    stop = spark.createDataFrame([("a",), ("c",)], "lemma string")
    want = [(1, ["b"]), (1, ["b"]), (2, []), (3, ["d"])]
    assert sorted(map(tuple, T.without_words(df, "w", stop).collect())) == want
    monkeypatch.setattr(T, "LITERAL_WORDS", 1)
    assert sorted(map(tuple, T.without_words(df, "w", stop).collect())) == want


class _Model:
    def __init__(self, width):
        self.width = width

    def __call__(self, texts):
        return [[float(len(t)), float(t.count("e"))] + [0.0] * (self.width - 2) for t in texts]


def test_user_encoder_and_its_width(spark):
    import sys
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    q = spark.createDataFrame([(1, "three"), (2, "")], "id long, question string")
    enc = PL.user_encoder(lambda: _Model(3), 3)
    assert {r.id: r.vec for r in q.select("id", enc("question").alias("vec")).collect()} == {1: [5.0, 2.0, 0.0], 2: [0.0, 0.0, 0.0]}
    with pytest.raises(Exception, match="another width"):
        q.select(PL.user_encoder(lambda: _Model(5), 3)("question")).collect()


def test_pipeline_with_given_vectors_and_with_an_encoder(spark):
    import sys
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    q = spark.createDataFrame([("A", i, f"question about {'cats' if i % 2 else 'the long river of stones'} {i}") for i in range(12)],
                              "corpus string, id long, question string")
    v = q.select("corpus", "id", F.array(*[F.when(F.col("id") % 2 == j, 1.0 + F.col("id") / 100).otherwise(0.0) for j in range(2)]).alias("vec"))
    for kind in ({"vectors": v}, {"encoder": PL.user_encoder(lambda: _Model(3), 3)}):
        out, rejects = PL.cluster_output(q, **kind)
        ids = [i for r in out.collect() for i in r.q_ids]
        assert sorted(ids) == list(range(12)) and rejects.count() == 0


def test_outliers_do_not_move_the_clusters(spark):
    rng = np.random.default_rng(1)
    X = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), [[60.0, -60.0]]])
    got = {r.id: r.label for r in PL.custom_cluster(_points(spark, X), "Agglomerative Clustering", [{"param": "threshold", "value": 5.0}]).collect()}
    assert got[60] == -1 and len(set(got.values()) - {-1}) == 2
    named = PL.readable_labels(spark.createDataFrame([(1, -1), (2, 0)], "id long, label int")).collect()
    assert {r.id: r.label for r in named} == {1: "uncategorized", 2: "0"}
