import math

from pyspark.sql import functions as F

from loomtext.operators import labels as LB


def _nmi_loop(grams_by_q, clusters, term, cluster, by_set):
    """Independent per-term, per-question count of the 2x2 table and NMI with the sign rule."""
    qs = list(grams_by_q)
    N = len(qs)
    members = clusters[cluster]
    member_sets = [grams_by_q[q] for q in members]

    def inside(q):
        return grams_by_q[q] in member_sets if by_set else q in members

    c = {(t, u): 0 for t in (0, 1) for u in (0, 1)}
    for q in qs:
        c[(int(term in grams_by_q[q]), int(inside(q)))] += 1
    p = {k: v / N for k, v in c.items()}
    pt = {t: p[(t, 0)] + p[(t, 1)] for t in (0, 1)}
    pu = {u: p[(0, u)] + p[(1, u)] for u in (0, 1)}
    info = sum(v * math.log2(v / (pt[t] * pu[u])) for (t, u), v in p.items() if v > 0)
    h = -sum(x * math.log2(x) for x in pt.values() if x > 0) - sum(x * math.log2(x) for x in pu.values() if x > 0)
    v = 2 * info / h if info != 0 and h != 0 else 0.0
    if c[(1, 1)] == 0:
        return 0.0
    if c[(1, 1)] / (c[(1, 1)] + c[(1, 0)]) < len(members) / N:
        v = -v
    return v


def test_nmi_by_id_and_by_gramset(spark):
    grams_by_q = {1: frozenset({"A", "B"}), 2: frozenset({"A"}), 3: frozenset({"A", "B"}), 4: frozenset({"C"}),
                  5: frozenset(), 6: frozenset({"B", "C"}), 7: frozenset()}
    clusters = {0: [1, 2, 5], 1: [3, 4], 2: [6, 7]}
    g = spark.createDataFrame([(0, q, t) for q, ts in grams_by_q.items() for t in ts], "corpus int, id int, gram string")
    m = spark.createDataFrame([(0, q, c) for c, qs in clusters.items() for q in qs], "corpus int, id int, cluster_id int")
    for by_set in (False, True):
        got = {(r.cluster_id, r.gram): r.nmi for r in LB.nmi(LB.contingency_by_corpus(g, m, by_set)).collect()}
        for c in clusters:
            for t in ("A", "B", "C"):
                want = _nmi_loop(grams_by_q, clusters, t, c, by_set)
                assert abs(got.get((c, t), 0.0) - want) < 1e-12, (by_set, c, t)
