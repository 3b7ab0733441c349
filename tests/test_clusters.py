import math

import regex as re
from pyspark.sql import functions as F

from conftest import SF
from loomtext.operators import greedy as GR
from loomtext.operators import labels as LB
from loomtext.operators import match as MT
from loomtext.plans import fixtures as FX
from loomtext.streaming import stream_match as ST


def _py_lemmas(text):
    t = text.replace("\n", "").replace("'", " ")
    t = re.sub("&lt;/?.*?&gt;", "&lt;&gt;", t)
    t = re.sub(r"[^\p{L}\p{N}\p{M}_ ]", "", t)
    return [w.lower() for w in re.findall(r"[\p{L}\p{N}\p{M}_]+", t)]


def test_greedy_matches_reference_algorithm(spark):
    """Brute force of the reference loop (sets, rarest eligible keyword, removal) on sf0.001."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    freq = {r.lemma: r.freq for r in FX.background(spark, SF).collect()}
    stop = {r.lemma for r in FX.stop_list(spark, SF).collect()}
    kcs = {}
    for i, text in docs:
        for lem in set(_py_lemmas(text)):
            kcs.setdefault(lem, set()).add(i)
    n = len(docs)
    lo, hi = max(math.ceil(n * 0.08), 2), math.ceil(n * 0.2)
    want = {}
    while True:
        cands = [k for k, v in kcs.items() if lo <= len(v) <= hi and k not in stop and 0 < freq.get(k, 0) < 1]
        if not cands:
            break
        kw = min(cands, key=lambda k: (freq[k], k))
        chosen = kcs.pop(kw)
        for i in chosen:
            want[i] = kw
        for v in kcs.values():
            v -= chosen
    got = {r.id: r.label for r in GR.greedy_clusters(FX.doc_questions(spark, SF), FX.background(spark, SF),
                                                      FX.stop_list(spark, SF)).collect()}
    assert got == {i: want.get(i, "uncategorized") for i, _ in docs}


def test_match_array_and_join_forms_agree_and_stream_equals_batch(spark, tmp_path):
    q = FX.doc_questions(spark, SF)
    kw, bg = FX.keywords(spark, SF), FX.background(spark, SF)
    a = {r.id: r.label for r in MT.match_categories(q, kw, bg, method="array").collect()}
    b = {r.id: r.label for r in MT.match_categories(q, kw, bg, method="join").collect()}
    assert a == b and len(a) == 200
    src = tmp_path / "in"
    q.select("id", "question").repartition(3).write.parquet(str(src))
    out = ST.run_available_now(spark, str(src), "id long, question string", kw, bg,
                               str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    assert {r.id: r.label for r in out.collect()} == a


def test_label_rule_cases(spark):
    cases = [
        (["CAT", "BIG DOG", "X", "Y"], ["CAT", "BIG DOG"]),
        (["DOG", "BIG DOG", "RED FOX", "Y"], ["BIG DOG", "RED FOX"]),
        (["DOG", "BIG DOG", "BIG", "Y"], ["BIG DOG", "Y"]),
        (["A", "B", "C", "D"], ["A", "B"]),
        (["AB", "CD", "EF", "AB CD"], ["EF", "AB CD"]),
        (["AB", "XY", "AB Q", "Z"], ["XY", "AB Q"]),
        (["AB", "XY", "AB XY", "Z"], ["AB XY", "Z"]),
        (["RED FOX", "RED", "BLUE", "Z"], ["RED FOX", "BLUE"]),
        (["RED FOX", "GREEN", "X", "Y"], ["RED FOX", "GREEN"]),
        (["RED FOX", "BIG DOG", "X", "Y"], ["RED FOX", "BIG DOG"]),
        (["ONLY", "TWO"], ["ONLY", "TWO"]),
    ]
    rows = [(c, lab, r + 1) for c, (labs, _) in enumerate(cases) for r, lab in enumerate(labs)]
    df = spark.createDataFrame(rows, "cluster_id int, label string, rank int")
    got = {r.cluster_id: r.labels for r in LB.best_label_combination(df).collect()}
    assert [got[c] for c in range(len(cases))] == [w for _, w in cases]
