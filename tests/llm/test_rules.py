import random
from collections import Counter

import numpy as np
import pyarrow as pa

from loomtext.llm import rules
from loomtext.llm import textstats as S
from helpers import docs, odd_texts, words


def _plain(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
    twice = Counter(windows)
    covered = {j for k, x in enumerate(windows) if twice[x] > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_base_statistics(spark):
    rng = random.Random(7)
    given = odd_texts() + [(500 + i, "".join(rng.choice("ab \n#|é") for _ in range(rng.randint(0, 150)))) for i in range(60)]
    got = rules.quality_rules(docs(spark, given), min_rows=20).collect()
    want = sorted([((-1 if i is None else i), *_plain(t), len(words(t)) < 20 or 100 * _plain(t)[4] > 30 * len(words(t))) for i, t, *_ in given])
    assert sorted([(-1 if r[0] is None else r[0], *r[1:7]) for r in got]) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_window_hash_collisions_are_resolved(monkeypatch):
    """With a hash that is always equal the words still decide."""
    class Zero:
        def integers(self, lo, hi, n, kind):
            return np.zeros(n, kind)
    text = ["a b c d e f g h a b c d e f g h x", "q w e r t y u i o p a s d f g h"]
    want = S.statistics(pa.array(text))["n_repeat_words"].tolist()
    real = np.uint64(0)
    monkeypatch.setattr(S.np.random, "default_rng", lambda *_: Zero())
    assert want == [16, 0] and S.statistics(pa.array(text))["n_repeat_words"].tolist() == want and real == 0


def _plain_mcd(x, share=0.75):
    """Concentration steps with the selection by whole cells, on one group."""
    def nearest(m, inv, part):
        d = np.einsum("ni,ij,nj->n", x - m, inv, x - m)
        cell = np.floor(np.log(np.maximum(d, 1e-9)) * rules.LOG_CELLS)
        return cell <= np.sort(cell)[int(np.ceil(part * len(x))) - 1], d
    med = lambda v: np.array([(np.sort(np.floor(c * rules.CELLS))[int(np.ceil(0.5 * len(c))) - 1] + 0.5) / rules.CELLS for c in v.T])
    m = med(x)
    inv = np.diag(1 / np.maximum(1.4826 * med(np.abs(x - m)), rules.FLOOR) ** 2)
    fit = lambda rows, f: (rows.mean(0), np.linalg.inv(np.cov(rows.T, bias=True) * f + np.eye(rules.D) * rules.FLOOR ** 2))
    last = np.inf
    while True:
        near, _ = nearest(m, inv, share)
        step = fit(x[near], rules.consistency(share, rules.D))
        now = -np.linalg.slogdet(step[1])[1]
        if now >= last - 1e-6:
            break
        (m, inv), last = step, now
    _, d = nearest(m, inv, share)
    return fit(x[d <= rules.chi2_quantile(0.975, rules.D)], rules.consistency(0.975, rules.D))


def test_distributed_estimate_equals_plain_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, rules.D)) @ rng.normal(size=(rules.D, rules.D)) + 3
    x[:60] += 40
    groups = {"g": x, "h": rng.normal(size=(400, rules.D)) * np.arange(1, rules.D + 1), "i": rng.standard_t(2, size=(300, rules.D))}
    rows = spark.createDataFrame([(g, v.tolist()) for g, part in groups.items() for v in part], "g string, x array<double>").repartition(5)
    fitted = {r.g: r for r in rules.fit(rows).collect()}
    assert set(fitted) == set(groups)
    for g, part in groups.items():  # groups settle after different numbers of steps
        m, inv = _plain_mcd(part)
        assert np.allclose(fitted[g].m, m, atol=1e-6) and np.allclose(np.array(fitted[g].inv).reshape(inv.shape), inv, rtol=1e-5, atol=1e-6)
    got = fitted["g"]
    inv = np.array(got.inv).reshape(rules.D, rules.D)
    d = np.einsum("ni,ij,nj->n", x - got.m, np.array(got.inv).reshape(inv.shape), x - got.m)
    assert (d[:60] > rules.chi2_quantile(0.99999, rules.D)).all() and (d[60:] < rules.chi2_quantile(0.99999, rules.D)).mean() > 0.99


def test_outliers_are_rejected_clean_texts_kept(spark):
    rng = random.Random(9)
    clean = lambda: " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(40, 200))).capitalize() + "."
    given = [(i, clean(), "en", "s1" if i % 3 else "s2") for i in range(600)]
    given += [(1000 + i, clean().replace(" ", " | ").upper(), "en", "s1") for i in range(30)]
    got = rules.quality_rules(docs(spark, given)).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in got)


def test_chi_square():
    assert abs(rules.chi2_quantile(0.95, 1) - 3.841459) < 1e-4
    assert abs(rules.chi2_quantile(0.99, 7) - 18.475307) < 1e-4


def test_empty_table(spark):
    assert rules.quality_rules(docs(spark, [])).count() == 0
