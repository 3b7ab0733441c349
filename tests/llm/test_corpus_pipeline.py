import importlib

from pyspark.sql import functions as F

import corpus_pipeline as P
from helpers import docs, odd_texts

SF = "/root/testdata/sf0.001"


def test_stages_over_the_small_tables(spark, tmp_path):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r for r in frame.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, frame, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(P.STAGES) - 1:
            assert out.columns == frame.columns, name
        if k == 0:
            assert all(r.doc_id in {x.doc_id for x in out.collect()} for r in before.values() if labels.get(r.doc_id) == 1 and r.n_chars > 200)
        if k in (0, 2):
            assert out.count() <= frame.count() and out.select("doc_id").distinct().count() == out.count()
        frame = out
    assert frame.count() > 0 and frame.where("n_tokens > 0").count() == frame.count() - frame.where("n_tokens = 0").count()


def test_mix_takes_copies_of_rows(spark):
    from loomtext.llm import mixing
    given = odd_texts()
    frame = docs(spark, given)
    out = P.mix(spark, frame, SF)
    assert out.columns == frame.columns
    want = mixing.mix(frame).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {r.doc_id: r.n for r in want}


def test_stages_take_odd_rows_and_empty_tables(spark):
    for given in (odd_texts(), []):
        frame = docs(spark, given)
        for _, stage in P.STAGES:
            assert stage(spark, frame, SF).count() >= 0


def test_near_copies_keeps_the_smallest_id(spark):
    a, b = "one two three four five six " + "seven " * 20, "quite another text of a few words"
    given = [(i, a) for i in (5, 3, 9, 9, None)] + [(7, b), (5, "a text unlike A that shares its id with a copy of A"), (None, "nobody's text"), (None, "nobody's text")]
    got = sorted(((r.doc_id, r.text) for r in P.near_copies(spark, docs(spark, given).repartition(3), SF).collect()), key=repr)
    assert got == sorted([(3, a), (5, "a text unlike A that shares its id with a copy of A"), (7, b), (None, "nobody's text")], key=repr)


def test_lines_drops_what_some_hundredths_of_a_source_share(spark):
    given = [(i, f"text number {i}\n" + "Licensed alike.\n" * (i % 25 == 0) + "Only here." * (i % 100 == 1)) for i in range(200)]
    got = {r.doc_id: r.text for r in P.lines(spark, docs(spark, given), SF).collect()}
    assert len(got) == 200 and not any("Licensed alike." in t for t in got.values())
    assert all("text number" in t for t in got.values()) and sum("Only here." in t for t in got.values()) == 2


def test_run_equals_the_stages(spark):
    importlib.reload(P)
    assert [n for n, _ in P.STAGES][0] == "quality classifier" and len(P.STAGES) == 5 and P.ORACLE_SQL is None
    assert P.run(spark, SF).columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
