import random

import numpy as np
import pytest
import xxhash

from loomtext.llm import simhash
from loomtext.llm.components import components
from helpers import UPPER, docs, odd_texts, words


def _print(text, size):
    w = words((text or "").translate(UPPER))
    shingles = [" ".join(w[k:k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(prints, bits):
    keys = list(prints)
    low = {k: k for k in keys}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return {k: find(k) for k in keys}


def _given():
    rng = random.Random(8)
    out = [r for r in odd_texts() if r[0] is not None]
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(300)]
    for i in range(60):  # a chain of near copies
        base[rng.randrange(300)] = f"w{i}"
        out.append((400 + i, " ".join(base)))
    return out


def test_equals_all_pairs(spark):
    given = _given()
    got = simhash.near_duplicates(docs(spark, given), 4, 4).collect()
    prints = {i: _print(t, 4) for i, t, *_ in given}
    assert sorted((r.doc_id, r.fp % (1 << 64)) for r in got) == sorted((i, _print(t, 4)) for i, t, *_ in given)
    want = _classes(prints, 4)
    assert all(r.component_id == want[r.doc_id] for r in got) and len(got) == len(given)
    assert len(set(want.values())) < len(want) - 20


def test_crowded_buckets_and_tiles(spark, monkeypatch):
    """Thousands of fingerprints around a few centres: contraction and tiles lose no link."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = set()
    while len(prints) < 900:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    by = {signed(x): x for x in prints}
    want = _classes(by, 4)
    monkeypatch.setattr(simhash, "TILE", 100)
    links = simhash.links(spark.createDataFrame([(x,) for x in by], "fp long"), 4)
    got = {r.node: r.component for r in components(links).collect()}
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert groups({k: got.get(k, k) for k in by}) == groups(want)
    assert links.count() < 20 * len(by) * 3


@pytest.mark.parametrize("bits", [0, 1, 4, 8])
def test_pivot_filter_discards_no_link(bits):
    rng = np.random.default_rng(bits)
    fp = rng.integers(0, 1 << 63, 300, np.int64).astype(np.uint64)
    fp = np.concatenate([fp, fp ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))])
    member, root = simhash.bucket_links(np.zeros(len(fp), int), fp, bits, simhash.pivot_references(16), crowded=10_000)
    again, root2 = simhash.bucket_links(np.zeros(len(fp), int), fp, bits, simhash.pivot_references(16), crowded=1)
    want = _classes(dict(enumerate(map(int, fp))), bits)
    for m, r in ((member, root), (again, root2)):
        low = np.arange(len(fp))
        low[m] = r
        assert all(low[i] == want[i] for i in range(len(fp)))


def test_two_linked_prints_share_two_blocks():
    bounds = simhash.block_bounds(4)
    assert bounds[0][0] == 0 and bounds[-1][1] == 64 and len(bounds) == 6 and all(a < b for a, b in bounds)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows_and_empty_table(spark):
    got = simhash.near_duplicates(docs(spark, odd_texts()), 4, 4).collect()
    assert len(got) == len(odd_texts())
    assert all(r.fp == 0 for r in got if r.doc_id in (100, 101, 102))
    assert simhash.near_duplicates(docs(spark, []), 4, 4).count() == 0
