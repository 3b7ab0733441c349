import hashlib
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomtext.llm import common as C
from loomtext.llm import exact_dedup, fuse
from helpers import UPPER, docs, odd_texts


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 20_000])
def test_filter_finds_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64)
    f = fuse.build(np.concatenate([keys, keys[:n // 2]]))
    assert fuse.contains(f, keys).all()
    assert fuse.contains(f, rng.integers(0, 1 << 63, 50_000, np.int64).astype(np.uint64)).mean() < 0.001
    assert n < 20_000 or f.slots.nbytes < 2 * 1.3 * n


def _plain(given):
    norm = [(t or "").translate(UPPER) for _, t, *_ in given]
    low = lambda i: -1 if i is None else i
    out = []
    for (i, *_), x in zip(given, norm):
        same = [low(j) for (j, *_), y in zip(given, norm) if y == x]
        out.append((low(i), max(same), len(same), hashlib.sha256(x.encode()).hexdigest()))
    return sorted(out)


def _given():
    out = odd_texts()
    out += [(300 + i, "One Much Copied text" if i % 2 else "one much copied TEXT") for i in range(80)]
    return out + [(400 + i, f"pair {i // 2}") for i in range(60)] + [(501, "É"), (502, "é")]


def _run(df, **kind):
    part = C.fold(F.col("doc_id"), 4)
    return exact_dedup.dedup(df.withColumn("snapshot", F.when(part > 0, part)), **kind).collect()


def _check(got, given):
    low = lambda i: -1 if i is None else i
    want = _plain(given)
    assert sorted((low(r.doc_id), low(r.keep_id), r.group_size) for r in got) == sorted(w[:3] for w in want)
    kept = [low(r.doc_id) for r in got if r.kept]
    assert sorted(kept) == sorted({w[1] for w in want})  # one row of each group


def test_equals_plain_version(spark):
    got = _run(docs(spark, _given()))
    _check(got, _given())
    assert sorted(((-1 if r.doc_id is None else r.doc_id), bytes(r.digest).hex()) for r in got) == sorted((w[0], w[3]) for w in _plain(_given()))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import tests


def _weak(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:1]


def test_colliding_digests_are_told_apart_by_bytes(spark):
    given = [(i, t) for i, t, *_ in _given() if i not in (None, 104)]
    _check(_run(docs(spark, given), digest=_weak), given)


def test_shuffled_form_shards_and_salts(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 16)
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 8)
    _check(_run(docs(spark, _given())), _given())


def test_only_snapshots_only_batch_and_empty(spark):
    given = _given()
    for snapshot in (F.lit(None).cast("int"), F.lit(1)):
        _check(exact_dedup.dedup(docs(spark, given).withColumn("snapshot", snapshot)).collect(), given)
    assert _run(docs(spark, [])) == []
