"""Label scores count grams where the questions are read, and take both lengths in the same few jobs."""
import pytest
from pyspark.sql import functions as F

from loomtext.operators import labels as LB
from loomtext.plans import pipelines as PL

QUESTIONS = [("A", 1, "red fox and red hen"), ("A", 2, "red hen"), ("A", 3, None), ("A", 4, ""), ("B", 1, "blue sky"), ("B", 1, "blue sky over ÉLAN"),
             ("B", 2, "deep blue sea"), ("B", None, "lost words"), ("B", None, "lost words"), (None, 5, "no corpus"), ("C", 7, "alone"), ("D", 1, "no member")]
MEMBERS = [("A", 1, 0), ("A", 2, 1), ("A", 3, 1), ("A", 4, None), ("B", 1, 0), ("B", 1, 0), ("B", 1, 1), ("B", 2, 1), ("B", None, 1), (None, 5, 0), ("C", 7, 0), ("E", 1, 3)]


def _tables(spark):
    q = spark.createDataFrame(QUESTIONS, "corpus string, id long, question string")
    return q, spark.createDataFrame(MEMBERS, "corpus string, id long, cluster_id int")


@pytest.mark.parametrize("words", [1, 1 << 18])
def test_counts_are_those_of_gram_sets(spark, monkeypatch, words):
    monkeypatch.setattr(LB, "COUNTED_WORDS", words)
    q, m = _tables(spark)
    lists = LB.lemma_lists(q, keep=("corpus",))
    sets = lists.select("corpus", "id", F.explode(F.concat(*(LB.T.ngrams(F.col("lems"), n) for n in (1, 2)))).alias("gram")).distinct()
    want = LB.contingency_by_corpus(sets, m)
    got = LB.contingency_of_lists(lists, m, 1, 2)
    assert sorted(map(tuple, got.where("cluster_id is not null").select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    grams = got.where("corpus is not null").select("corpus", "gram").distinct().collect()
    assert sorted(map(tuple, grams)) == sorted(map(tuple, sets.where("corpus is not null").select("corpus", "gram").distinct().collect()))


def test_default_word_vectors_inside_a_task(spark):
    import pyarrow as pa
    texts = ["red", "red hen", "élan x", "a b c"]
    want = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(
        LB.mean_word_vector(F.split("t", " ")).alias("v")).collect()]
    assert LB._word_vectors(pa.array(texts), 16).tolist() == want


def test_scores_do_not_depend_on_the_blocks(spark, monkeypatch):
    q, m = _tables(spark)
    scores = lambda: sorted((r.corpus, r.cluster_id, r.gram_type, r.rank, r.label, round(r.score, 9)) for r in LB.label_scores(q, m, PL.encode(q)).collect())
    whole = scores()
    assert {r[0] for r in whole} == {"A", "B", "C"} and any(r[2] == 2 for r in whole)
    monkeypatch.setattr(LB, "TERM_BLOCK", 3)
    monkeypatch.setattr(LB, "CLUSTER_BLOCK", 1)
    assert scores() == whole


def test_few_jobs_for_both_lengths(spark):
    q, m = _tables(spark)
    sc = spark.sparkContext
    sc.setJobGroup("label-jobs", "label scores")
    try:
        LB.label_scores(q, m, PL.encode(q)).collect()
        assert len(sc.statusTracker().getJobIdsForGroup("label-jobs")) < 60
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
