"""Document frequencies counted without a shuffle of (id, lemma) rows, and the token stream kept as text."""
from __future__ import annotations

from loomtext.operators import labels as LB
from loomtext.plans import fixtures as FX
from loomtext.sources import tables as S

SCHEMA = "id long, lang string, lemmas array<string>"


def plain(docs):
    pairs = {(lang, i, w) for i, lang, ws in docs for w in ws or []}
    return {(lang, w): sum(p[0] == lang and p[2] == w for p in pairs) for lang, _, w in pairs}


def counts(df):
    return {(r.lang, r.lemma): r.df for r in df.collect()}


def test_lemma_documents(spark):
    once = [(1, "en", ["a", "b", "a"]), (2, "en", ["a"]), (3, None, ["b"]), (4, "de", []), (5, "de", None), (None, "de", ["a"])]
    df = S.lemma_documents(spark.createDataFrame(once, SCHEMA), "lang")
    assert counts(df) == plain(once)
    plan = df._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "hashpartitioning" in x]
    assert shuffles and not any("id#" in x.split("plan_id")[0].replace("plan_id", "") for x in shuffles)
    more = [*once, (1, "en", ["a", "c"]), (1, "de", ["a"]), (None, "de", ["a", "d"])]
    assert counts(S.lemma_documents(spark.createDataFrame(more, SCHEMA), "lang")) == plain(more)


def test_token_stream_kept_as_text(spark, tmp_path):
    docs = [(1, "Red  apple, red!", "en"), (2, None, "en"), (3, "  ", "de"), (3, "Élan_2", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in FX.doc_token_lemmas(spark, str(tmp_path)).fillna("-").collect())
    assert got == [(1, "en", "apple"), (1, "en", "red"), (1, "en", "red"), (3, "-", "élan_2")]


def test_sizes_of_clusters_are_joined_once(spark):
    grams = spark.createDataFrame([(0, 1, "a"), (0, 2, "a"), (0, 2, "b"), (1, 1, "a")], "corpus long, id long, gram string")
    members = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 1), (1, 1, 0)], "corpus long, id long, cluster_id int")
    df = LB.contingency_by_corpus(grams, members)
    assert df.columns == ["corpus", "cluster_id", "gram", "n11", "n1", "nc", "nc_true", "N"]
    assert sorted(tuple(r) for r in df.collect()) == [
        (0, 0, "a", 1, 2, 1, 1, 3), (0, 1, "a", 1, 2, 2, 2, 3), (0, 1, "b", 1, 1, 2, 2, 3), (1, 0, "a", 1, 1, 1, 1, 1)]
