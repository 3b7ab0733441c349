import math
import random
from collections import defaultdict

import pytest

from loomtext.llm import mixing
from helpers import docs, odd_texts, words


def _targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        rest = sum(w[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest and left * w[s] / rest >= cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else left * w[s] / rest for s in order}
        full |= over


def _given():
    return odd_texts() + [(1000 + i, "a b c d e " * (1 + i % 13) + "x" * (i % 2), "en", f"t{i % 5}") for i in range(400)] + [(3000 + i, "same size here", "en", "t0") for i in range(300)]


def test_targets_rates_and_rounding(spark):
    given = _given()
    got = mixing.mix(docs(spark, given)).collect()
    sizes = defaultdict(int)
    for _, t, _, s in given:
        sizes[s] += len(words(t))
    want = _targets(sizes)
    taken, biggest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        biggest[r.source] = max(biggest[r.source], r.size)
    assert len(got) == len(given)
    for s in sizes:
        if biggest[s] > want[s] / 2:  # one document is most of the source: nearest means within half of it
            assert abs(taken[s] - want[s]) <= biggest[s] / 2
        else:
            assert abs(taken[s] - want[s]) <= max(5, 0.002 * want[s])


def _dual(sizes, target, cap=2):
    """Plainly: the multiplier at which the tilted rates of all documents give the target, by bisection."""
    mean = sum(sizes) / len(sizes)
    rates = lambda lam: [min(cap, math.exp(min(lam * s / mean, 50))) for s in sizes]
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(s * r for s, r in zip(sizes, rates(mid))) < target else (lo, mid)
    return hi, dict(zip(sizes, rates(hi)))


def test_multipliers_and_copies_follow_the_plain_dual(spark):
    rng = random.Random(12)
    sizes = {"a": [rng.randint(1, 60) for _ in range(400)], "b": [rng.choice((3, 40)) for _ in range(300)], None: [rng.randint(5, 9) for _ in range(200)]}
    targets = {s: share * sum(x) for (s, x), share in zip(sizes.items(), (1.3, 0.4, 1.0))}
    classes = spark.createDataFrame([(s, k, x.count(k)) for s, x in sizes.items() for k in set(x)], "source string, size long, n long")
    goals = spark.createDataFrame([(s, targets[s], sum(x) / len(x)) for s, x in sizes.items()], "source string, target double, mean double")
    lam = {r.source: r.lam for r in mixing.multipliers(classes, goals, 2, 1e-9).collect()}
    for s, x in sizes.items():
        assert abs(lam[s] - _dual(x, targets[s])[0]) < 1e-6
    given = [(1000 * k + i, "w " * n, "en", s) for k, (s, x) in enumerate(sizes.items()) for i, n in enumerate(x)]
    out = mixing.mix(docs(spark, given)).collect()
    for s, x in sizes.items():
        mine = [r for r in out if r.source == s]
        if mine[0].target >= 2 * sum(x):
            assert all(r.copies == 2 for r in mine)
            continue
        rates = _dual(x, mine[0].target)[1]
        for part in (lambda n: n <= 10, lambda n: n <= 30, lambda n: True):  # copies follow the rates from the smallest size on
            want = sum(rates[r.size] for r in mine if part(r.size))
            # rounding leaves a gap of half the largest size at most, which copies of the smallest sizes fill
            assert abs(sum(r.copies for r in mine if part(r.size)) - want) <= 2 + max(x) / (2 * min(x))


def test_reruns_and_partitions_agree(spark):
    key = lambda out: sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.copies) for r in out.collect())
    assert key(mixing.mix(docs(spark, _given()))) == key(mixing.mix(docs(spark, _given()[::-1]).repartition(7)))


def test_cells_share_a_large_class(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 16)
    got = mixing.mix(docs(spark, [(i, "one two three", "en", "a" if i % 4 else "b") for i in range(800)])).collect()
    want = _targets({"a": 1800, "b": 600})
    for s in "ab":
        assert abs(sum(r.copies * 3 for r in got if r.source == s) - want[s]) <= 3


def test_tilt_rises_with_size_where_more_is_wanted(spark):
    given = [(i, "w " * (1 + i % 50), "en", "a") for i in range(500)]
    got = mixing.mix(docs(spark, given)).collect()  # 150% of a single source
    long_, short = ([r.copies for r in got if (r.size > 40) == x] for x in (True, False))
    assert sum(long_) / len(long_) > sum(short) / len(short) >= 1


def test_empty_and_wordless(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    got = mixing.mix(docs(spark, [(1, None), (2, ""), (3, " ")])).collect()
    assert [(r.size, r.target, r.copies) for r in got] == [(0, 0.0, 1)] * 3


def test_no_single_copy_brings_a_source_nearer(spark):
    given = [(100 * s + i, "w " * 2 ** i, "en", f"s{s}") for s in range(12) for i in range(13 - s % 3)]
    got = mixing.mix(docs(spark, given)).collect()
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        gap = mine[0].target - sum(r.size * r.copies for r in mine)
        for r in mine:
            assert r.copies == 2 or abs(gap - r.size) >= abs(gap) - 1e-6
            assert r.copies == 0 or abs(gap + r.size) >= abs(gap) - 1e-6
