from pyspark.sql import functions as F

from loomtext.functions import text as T


def test_clean_text_golden(spark):
    s = "There's this great, awesome, AMAZING place &lt;html&gt;... Have you been there?htmlhtml"
    df = spark.createDataFrame([(s,)], "t string")
    out = df.select(T.clean_text("t", lower=True).alias("c")).first()["c"]
    # apostrophe becomes a space; the escaped tag becomes the letters ltgt
    assert out == "there s this great awesome amazing place ltgt have you been therehtmlhtml"


def test_clean_text_unicode_word_chars(spark):
    df = spark.createDataFrame([("Élan—vital_2 ß!",)], "t string")
    assert df.select(T.clean_text("t").alias("c")).first()["c"] == "Élanvital_2 ß"


def test_pair_index_golden(spark):
    rows = [(3, 3), (4, 6), (6, 3), (5, 10), (7, 7)]
    df = spark.createDataFrame(rows, "n long, pos long")
    got = [(r.r, r.c) for r in df.select(T.pair_row("n", "pos").alias("r"), T.pair_col("n", "pos").alias("c")).collect()]
    assert got == [(1, 2), (2, 3), (0, 3), (3, 4), (1, 2)]


def test_pair_index_exhaustive(spark):
    rows, want = [], []
    for n in range(2, 25):
        p = 0
        for i in range(n):
            for j in range(i + 1, n):
                p += 1
                rows.append((n, p))
                want.append((i, j))
    df = spark.createDataFrame(rows, "n long, pos long")
    got = [(r.r, r.c) for r in df.select(T.pair_row("n", "pos").alias("r"), T.pair_col("n", "pos").alias("c")).collect()]
    assert got == want


def test_ngrams_and_label_type(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b", "c"],), (["x"],), ([],)], "w array<string>")
    r = df.select(T.ngrams("w", 2).alias("g")).collect()
    assert r[0].g == ["a b", "b a", "b c"] and r[1].g == [] and r[2].g == []
    lt = spark.createDataFrame([("ONE",), ("TWO WORDS",)], "l string").select(T.label_type("l").alias("t")).collect()
    assert [x.t for x in lt] == [1, 2]


def test_question_text_empty_to_space(spark):
    df = spark.createDataFrame([("!!!",), ("a\nb",)], "t string")
    assert [r.q for r in df.select(T.question_text("t").alias("q")).collect()] == [" ", "ab"]


def test_l2_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    r = df.select(T.l2_normalize("v").alias("n")).collect()
    assert r[0].n == [0.6, 0.8] and r[1].n == [0.0, 0.0]


def test_pair_index_of_many_rows(spark):
    n = 256_410  # (2 n - 1)^2 leaves 32 bits
    last = n * (n - 1) // 2
    df = spark.createDataFrame([(1,), (n - 1,), (n,), (last,)], "pos long")
    got = [(r.r, r.c) for r in df.select(T.pair_row(F.lit(n), "pos").alias("r"), T.pair_col(F.lit(n), "pos").alias("c")).collect()]
    assert got == [(0, 1), (0, n - 1), (1, 2), (n - 2, n - 1)]
