"""Fitted corpus model, learned word vectors and ML stages against plain versions."""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from loomtext.operators import corpusmodel as CM
from loomtext.operators import wordvectors as WV

DOCS = [(1, ["red", "apple", "red"]), (2, ["blue", "car"]), (3, ["red", "car", None]), (4, []), (5, None), (2, ["blue"])]


def tokens(spark, rows):
    return spark.createDataFrame([(i, w) for i, ws in rows for w in ws or []], "id long, lemma string")


def weights(train, docs, n):
    df = Counter(w for _, ws in merged(train) for w in set(ws))
    out = {}
    for i, ws in merged(docs):
        v = {w: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in Counter(ws).items() if w in df}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out |= {(i, w): x / norm for w, x in v.items()}
    return out


def merged(rows):
    by = {}
    for i, ws in rows:
        by.setdefault(i, []).extend(w for w in ws or [] if w is not None)
    return by.items()


def test_model_versions_and_weights(spark, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(ValueError):
        CM.load_corpus(spark, path)
    assert CM.fit_corpus(tokens(spark, DOCS[:2]), path) == 1
    # a fit that stopped before its last step leaves terms without a row of their own
    spark.createDataFrame([("stale", 1, 1.0)], "lemma string, df long, idf double").write.parquet(f"{path}/terms/version=2")
    assert CM.load_corpus(spark, path).version == 1
    assert CM.fit_corpus(tokens(spark, DOCS), path, n_docs=5) == 2
    later = [(7, ["red", "red", "car", "unknown"]), (8, ["unknown"]), (9, ["apple", None])]
    for version, train, n in ((1, DOCS[:2], 2), (2, DOCS, 5), (None, DOCS, 5)):
        model = CM.load_corpus(spark, path, version)
        assert model.n_docs == n
        want = weights(train, later, n)
        for limit in (64 << 20, 0):  # broadcast and joined by key
            got = {(r.id, r.lemma): r.w for r in CM.weigh(model, tokens(spark, later), limit).collect()}
            assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        CM.load_corpus(spark, path, 9)
    assert CM.fit_corpus(tokens(spark, DOCS).limit(0), path) == 3
    empty = CM.load_corpus(spark, path)
    assert (empty.n_docs, CM.weigh(empty, tokens(spark, later)).count()) == (0, 0)


def test_stream_equals_batch(spark, tmp_path):
    path, src = str(tmp_path / "model"), str(tmp_path / "in")
    CM.fit_corpus(tokens(spark, DOCS), path)
    model = CM.load_corpus(spark, path)
    later = [(10, ["red", "car"]), (11, ["blue", "blue"]), (12, None), (13, ["none"])]
    spark.createDataFrame(later, "id long, lemmas array<string>").repartition(2).write.parquet(src)
    stream = spark.readStream.schema("id long, lemmas array<string>").option("maxFilesPerTrigger", 1).parquet(src)
    CM.weigh_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.id, r.lemma): r.w for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == pytest.approx({(r.id, r.lemma): r.w for r in CM.weigh(model, tokens(spark, later)).collect()})


def plain_pairs(docs, window, min_count):
    n = Counter(w for _, ws in docs for w in ws or [] if w is not None)
    c = Counter()
    for _, ws in docs:
        for i, a in enumerate(ws or []):
            for b in (ws or [])[i + 1:i + 1 + window]:
                if a and b and n[a] >= min_count and n[b] >= min_count:
                    c[a, b] += 1
                    c[b, a] += 1
    return dict(c)


@pytest.mark.parametrize("window,min_count", [(1, 1), (2, 1), (4, 2)])
def test_cooccurrence(spark, window, min_count):
    docs = DOCS + [(20, ["car", "car", "car", "red", "blue", "apple", "car"])]
    df = spark.createDataFrame(docs, "id long, lemmas array<string>")
    got = {(r.a, r.b): r.c for r in WV.cooccurrence(df, window, min_count).collect()}
    assert got == plain_pairs(docs, window, min_count)


@pytest.mark.parametrize("size,rank", [(30, 30), (30, 3), (5, 5)])
def test_leading_vectors_equal_the_eigenvectors(spark, size, rank):
    rng = np.random.default_rng(size + rank)
    base, _ = np.linalg.qr(rng.normal(size=(size, size)))
    values = np.zeros(size)
    values[:rank] = [(-1) ** i * 10.0 / (1.6 ** i) for i in range(rank)]
    M = base @ np.diag(values) @ base.T
    M = (M + M.T) / 2
    rows = [(f"w{i}", f"w{j}", float(M[i, j])) for i in range(size) for j in range(size)]
    got = {r.lemma: r.vec for r in WV.leading_vectors(spark.createDataFrame(rows, "a string, b string, m double"), 4, 1e-10).collect()}
    W = np.array([got[f"w{i}"] for i in range(size)])
    k = min(4, rank)
    assert W.shape[0] == size
    want = base[:, :k] * np.sqrt(np.abs(values[:k]))
    assert np.allclose(np.abs(W[:, :k]), np.abs(want), atol=1e-3)
    assert np.allclose(W[:, k:], 0, atol=1e-3)


def test_words_of_one_topic_lie_together(spark):
    rng = np.random.default_rng(3)
    topics = [[f"a{i}" for i in range(8)], [f"b{i}" for i in range(8)]]
    docs = [(d, [str(w) for w in rng.choice(topics[d % 2], 12)]) for d in range(60)]
    df = spark.createDataFrame(docs, "id long, lemmas array<string>")
    got = {r.lemma: np.array(r.vec) for r in WV.learn_word_vectors(df, dims=2).collect()}
    cos = lambda x, y: got[x] @ got[y] / (np.linalg.norm(got[x]) * np.linalg.norm(got[y]))
    assert min(cos("a0", f"a{i}") for i in range(8)) > 0.9 > 0.3 > max(abs(cos("a0", f"b{i}")) for i in range(8))
    assert WV.learn_word_vectors(df.limit(0)).count() == 0


def test_phrase_vectors(spark):
    table = spark.createDataFrame([("red", [1.0, 0.0]), ("car", [0.0, 2.0])], "lemma string, vec array<double>")
    got = {r.id: (r.n_known, r.vec) for r in WV.phrase_vectors(tokens(spark, [(1, ["red", "red", "car", "x"]), (2, ["x"]), (3, [None])]), table, 2).collect()}
    assert got[1] == (3, pytest.approx([2 / 3, 2 / 3]))
    assert got[2] == got[3] == (0, None)


def test_stages_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.functions import vector_to_array

    from loomtext.plans.stages import Lemmas, MeanWordVector

    df = spark.createDataFrame([(1, "Red apple"), (2, None), (3, ""), (4, "red")], "id long, text string")
    stages = [Lemmas(inputCol="text", outputCol="words", clean=False), MeanWordVector(inputCol="words", outputCol="v", dims=4)]
    fitted = Pipeline(stages=stages).fit(df)
    fitted.write().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    rows = lambda m: {r.id: (r.words, list(r.a)) for r in m.transform(df).select("id", "words", vector_to_array("v").alias("a")).collect()}
    got = rows(again)
    assert got == rows(fitted)
    assert got[1][0] == ["red", "apple"] and got[2] == got[3] == ([], [0.0] * 4) and len(got[4][1]) == 4
    assert again.stages[1].getOrDefault("dims") == 4
