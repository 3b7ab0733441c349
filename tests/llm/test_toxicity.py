import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from loomtext.llm import common as C
from loomtext.llm import toxicity as T
from helpers import docs, odd_texts

LABELS = "doc_id long, quality int, toxic int"
BAD = ["grumbleweed", "stinkfish", "nogoodnik", "fleabrain"]


def _corpus(n=600):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    out, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 60))]
        if i % 6 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(BAD).upper() + ",")
        out.append((i, " ".join(w)))
        if i % 4 < 3:
            labels.append((i, 1, int(i % 6 == 0)))
    return out, labels


def test_held_out_accuracy_and_evidence(spark):
    given, labels = _corpus()
    got = T.toxicity_scores(docs(spark, given), spark.createDataFrame(labels, LABELS), C.fold(F.col("doc_id"), 5) == 0).collect()
    held = [r for r in got if r.held_out]
    assert all((r.score >= 0.5) == (r.doc_id % 6 == 0) for r in held)
    assert all(e.doc_id != r.doc_id or e.n > 0 for r in got for e in r.evidence)
    assert all(r.evidence and r.evidence[0].cosine <= 1 + 1e-9 for r in got)


def test_block_search_equals_brute_force():
    rng = random.Random(6)
    terms = [(f"t{i}", rng.randint(1, 50)) for i in range(30)]
    number, idf = T.weigh(terms, 100)
    text = lambda: " ".join("t" + "abcdefghij"[rng.randrange(10)] for _ in range(rng.randint(0, 6))) + " zz" * rng.randint(0, 3)
    terms = [("t" + "abcdefghij"[i], 5 + i) for i in range(10)]
    number, idf = T.weigh(terms, 100)
    examples = []
    for i in range(700):
        t, w = T.vector(text(), number, idf)
        if len(t):
            examples.append((i, rng.randint(0, 1), t, w))
    index = T.build_index(examples, terms, 100)

    def dense(t, w):
        v = np.zeros(len(idf))
        v[t] = w
        return v
    table = np.stack([dense(t, w) for _, _, t, w in examples])
    for q in range(120):
        own = examples[q][0] if q % 2 else None
        t, w = (examples[q][2], examples[q][3]) if q % 2 else T.vector(text(), number, idf)
        found, cosines, n, toxic = T.neighbours(index, [(t, w)], 9, [own])[0]
        if not len(t):
            assert not len(found)
            continue
        all_cos = np.sort([c for c, e in zip(table @ dense(t, w), examples) if e[0] != own and c > 1e-12])[::-1]
        spread = np.repeat(cosines, n)
        assert len(spread) >= min(9, len(all_cos)) and np.allclose(spread[:9], all_cos[:9], atol=1e-9)
        assert (n > 0).all() and (toxic <= n).all()


def test_blocks_are_skipped_without_losing_a_neighbour(monkeypatch):
    """Examples in languages that share no frequent word: blocks of other languages are skipped, the
    neighbours are those of all examples."""
    monkeypatch.setattr(T, "BLOCK", 8)
    monkeypatch.setattr(T, "FIRST", 3)
    rng = random.Random(7)
    vocab = {la: [la + a + b for a in "abcdefgh" for b in "abcde"] for la in "qwxy"}
    text = lambda la: " ".join(rng.choice(vocab[la]) for _ in range(rng.randint(5, 40)))
    terms = sorted((w, 40) for words in vocab.values() for w in words)
    number, idf = T.weigh(terms, 800)
    examples = [(i, i % 2, *T.vector(text("qwxy"[i % 4]), number, idf)) for i in range(800)]
    index = T.build_index(examples, terms, 800)
    assert len(index.dense.table) > 30 and sorted(index.dense.order.tolist()) == list(range(len(index.n)))
    table = np.zeros((len(examples), len(idf)))
    for row, (_, _, t, w) in zip(table, examples):
        row[t] = w
    queries = [T.vector(text(rng.choice("qwxy")), number, idf) for _ in range(60)] + [T.vector("", number, idf), T.vector("unknown", number, idf)]
    own = [examples[i][0] if i % 3 == 0 else None for i in range(60)] + [None, None]
    queries = [(examples[i][2], examples[i][3]) if o is not None else q for i, (q, o) in enumerate(zip(queries, own))]
    _, scored, _ = T.block_scores(index, queries[:60], 9, [-1] * 60)
    assert 0 < scored.mean() < 0.6  # blocks skipped: more than two of five
    for (t, w), o, (found, cosines, n, _) in zip(queries, own, T.neighbours(index, queries, 9, own)):
        dense = np.zeros(len(idf))
        dense[t] = w
        want = np.sort([c for c, e in zip(table @ dense, examples) if e[0] != o and c > 1e-12])[::-1]
        assert np.allclose(np.repeat(cosines, n)[:9], want[:9], atol=1e-9) and len(np.repeat(cosines, n)) >= min(9, len(want))


def test_long_texts_leave_fewer_examples(spark):
    given, labels = _corpus(200)
    got = T.toxicity_scores(docs(spark, given), spark.createDataFrame(labels, LABELS), C.fold(F.col("doc_id"), 5) == 0, max_terms=1500).collect()
    every = T.toxicity_scores(docs(spark, given), spark.createDataFrame(labels, LABELS), C.fold(F.col("doc_id"), 5) == 0).collect()
    used = lambda rows: {e.doc_id for r in rows for e in r.evidence}
    assert len(got) == len(every) == 200 and 0 < len(used(got)) < 0.7 * len(used(every))


def test_copies_are_nearest_without_telling_terms(spark):
    """A held-out copy of a toxic example that shares no term tied to a label finds that example."""
    given, labels = _corpus()
    text = "an entirely plain passage whose toxicity no single word gives away"
    is_held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    one, other = (next(i for i in range(9000, 9100) if is_held(i) == h) for h in (False, True))
    given += [(one, text), (other, text)]
    got = {r.doc_id: r for r in T.toxicity_scores(docs(spark, given), spark.createDataFrame(labels + [(one, 1, 1)], LABELS),
                                                  C.fold(F.col("doc_id"), 5) == 0).collect()}
    first = got[other].evidence[0]
    assert (first.doc_id, first.n, first.toxic) == (one, 1, 1) and abs(first.cosine - 1) < 1e-9
    a, b = (got[next(i for i, r in got.items() if i < 600 and i % 6 and r.held_out == h)] for h in (True, False))
    assert a.evidence[0].cosine < 1 and b.evidence[0].n == 1  # plain texts do not collapse into one entry


def test_isotonic():
    out = T.isotonic([(0.0, 10, 1), (0.5, 10, 5), (0.7, 10, 3), (1.0, 10, 9)])
    rates = [p for _, p in out]
    assert rates == sorted(rates) and rates[1] == rates[2]


def test_odd_texts_and_empty_tables(spark):
    given, none = odd_texts(), spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (None, 0, 1), (3, 7, 5), (4, 0, 0)], LABELS)
    for labels in (none, odd):
        got = T.toxicity_scores(docs(spark, given), labels, C.fold(F.col("doc_id"), 5) == 0).collect()
        assert len(got) == len(given) and all(0 <= r.score <= 1 for r in got)
        assert T.toxicity_scores(docs(spark, []), labels, F.lit(False)).count() == 0
