"""Counts taken where rows are read give what the joins of gram sets give, and shuffle no (id, gram) rows."""
import random

from pyspark.sql import functions as F

from loomtext.operators import greedy as GR
from loomtext.operators import labels as LB


def _rows(spark, ids):
    rng = random.Random(3)
    return spark.createDataFrame([(i, rng.choice(["a", "b", None]), [rng.choice("PQRSTU") for _ in range(rng.randrange(6))]) for i in ids],
                                 "id long, cluster_id string, lems array<string>")


def test_contingency_of_rows_equals_the_join_of_gram_sets(spark):
    for ids in (range(40), [i % 25 if i % 9 else None for i in range(60)]):  # ids once; repeated and null ids
        rows = _rows(spark, ids).cache()
        want = LB.contingency(LB.gram_sets(rows, 1), rows).unionByName(LB.contingency(LB.gram_sets(rows, 2), rows))
        got = LB.contingency_of_rows(rows, 1, 2)
        assert got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        grams = LB.gram_sets(rows, 1).union(LB.gram_sets(rows, 2)).select("gram").distinct()
        assert sorted(LB.global_keywords_of_lists(rows, 1, 2).collect()) == sorted(grams.collect())


def test_contingency_of_rows_shuffles_counts_only(spark):
    rows = spark.range(4000).select("id", F.lit("a").alias("cluster_id"), F.array(F.lit("P"), F.lit("Q")).alias("lems"))
    plan = LB.contingency_of_rows(rows, 1)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert shuffled and not any("(id#" in line for line in shuffled), plan


def test_greedy_keeps_eligible_words_where_rows_are_read(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    for ids in (range(50), [i % 40 if i % 11 else None for i in range(60)]):  # ids once; repeated and null ids
        rows = spark.createDataFrame([(i, [rng.choice(words) for _ in range(rng.randrange(5))] if n % 7 else None) for n, i in enumerate(ids)],
                                     "id long, lemmas array<string>").cache()
        questions = rows.select("id", F.lit("").alias("question"))
        freq = spark.createDataFrame([(w, (1 + n * 7 % 30) / 1000) for n, w in enumerate(words)], "lemma string, freq double")
        want, chosen = GR.greedy_clusters(questions, freq, tokens=rows.select("id", F.explode("lemmas").alias("lemma")), return_keywords=True)
        got, mine = GR.greedy_clusters(questions, freq, lemmas=rows, return_keywords=True)
        assert chosen and mine == chosen
        order = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert order(got) == order(want)
