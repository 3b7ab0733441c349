import numpy as np

from loomtext import session
from loomtext.operators import kmeans as KM
from loomtext.operators import pairs as PR


def test_tables_too_large_to_share_are_joined(spark, monkeypatch):
    """Centres and moments sent once give the rows that joined ones give."""
    X = np.random.default_rng(2).normal(size=(24, 3))
    pts = spark.createDataFrame([(i % 2, i, [float(v) for v in x]) for i, x in enumerate(X)], "corpus long, id long, vec array<double>")
    centres = spark.createDataFrame([(c, 0, j, [float(v) for v in X[2 * j + c]]) for c in (0, 1) for j in range(3)],
                                    "corpus long, restart int, label int, vec array<double>")

    def both():
        return (sorted((r.corpus, r.id, r.label) for r in KM.nearest_centre(pts, centres).collect()),
                sorted((r.corpus, r.id, round(r.mean, 12), round(r.std, 12)) for r in PR.row_stats(pts).collect()))

    shared = both()
    for module in (KM, PR):
        monkeypatch.setattr(module, "share_if_small", lambda df: None)
    assert both() == shared


def test_share_is_bounded(spark):
    df = spark.createDataFrame([(1, [1.0] * 100), (2, [2.0] * 100), (2, [3.0])], "corpus long, vec array<double>")
    assert [r["vec"][0] for r in sorted(session.share_if_small(df).value[2])] == [2.0, 3.0]
    assert session.share_if_small(df, max_rows=2) is None
    assert session.share_if_small(df, max_bytes=1000) is None
