import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from loomtext.llm import fim
from helpers import docs, odd_texts

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _plain(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= rate:
        return n, "plain", text, None, None
    x, y = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if d % 100 < spm:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def _given():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéß😀") for _ in range(rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(900)) for _ in range(3)]
    out = odd_texts()
    for i in range(1000, 1120):
        own = [word() for _ in range(rng.randint(0, 60))]
        text = rng.choice([" ", "\n", "\t  "]).join(own) + rng.choice(["", " ", "\n\n"]) + rng.choice(shared) + rng.choice(["", "\r\n", "<", "<P", ">"])
        out.append((i, text))
    out += [(1200 + k, t) for k, t in enumerate(["a" * 30_000, " " * 30_000, "a " * 20_000, "\n" + "x" * 9000 + "\n", "<P>", "a <S> b", "y" * 300 + "<M>" + "z" * 9000, "<", "<P", "S>", "é", "\x1c"])]
    return out + [(1300 + k, "lead <" * k + "P" * (k % 3) + "> tail words here") for k in range(60)]


def _check(given, got, **plan):
    assert len(got) == len(given)
    key = lambda r: (repr(r[0]), r[1] or "")
    want = sorted(((i, t or "", *_plain(i, t, **plan)) for i, t, *_ in given), key=key)
    have = sorted(((r.doc_id, r.back, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in got), key=key)
    assert have == want
    return {w[3] for w in want}


def _run(spark, given, plan):
    out = fim.fill_in_middle(docs(spark, given), plan)
    return out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()


def test_equals_a_plain_version_and_restores(spark):
    given = _given()
    assert _check(given, _run(spark, given, fim.Plan())) == {"plain", "spm", "psm"}
    given = [(i if k % 7 else None, t) for k, (i, t, *_) in enumerate(given)] + [(1000, "a repeated id"), (1000, "a repeated id")]
    _check(given, _run(spark, given, fim.Plan(7, 100, 50)), seed=7, rate=100, spm=50)


def test_empty_table(spark):
    assert fim.fill_in_middle(docs(spark, [])).count() == 0


def test_shared_passages_meet_in_the_cache():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefg hijk") for _ in range(40_000)).encode()
    cache = fim.Cache()
    for head in (b"", b"one two ", b"another beginning, longer than the first one\n" * 20):
        data = head + passage
        hits = fim.candidates(np.frombuffer(data, np.uint8))
        fim.transform_text(data, hits, 0, 1, fim.Plan(), cache)
    assert cache.hits >= 1.7 * cache.misses  # two of three readings of the passage


def test_a_hash_that_collides_changes_nothing(monkeypatch):
    monkeypatch.setattr(fim.xxhash, "xxh3_64_intdigest", lambda chunk: len(chunk) % 3)
    cache = fim.Cache(limit=2000)
    for i, text, *_ in _given():
        data = (text or "").encode()
        hits = fim.candidates(np.frombuffer(data, np.uint8)) if data else []
        n, form, output, prefix, middle = fim.transform_text(data, hits, 0, i, fim.Plan(42, 100, 80), cache)
        assert (n, form, output.decode(), prefix, middle) == _plain(i, text, rate=100)


def test_chunks_do_not_depend_on_what_stands_before():
    rng = random.Random(4)
    passage = bytes(rng.randrange(256) for _ in range(60_000))
    cut = lambda head: [e - len(head) for e in fim.chunk_ends(0, len(head) + len(passage), fim.candidates(np.frombuffer(head + passage, np.uint8)))]
    a, b = set(cut(b"")), {e for e in cut(b"x" * 5000) if e > 0}
    assert len(a & b) >= 0.8 * max(len(a), len(b))
    ends = sorted(a)
    assert all(x <= fim.MOST for x in np.diff([0, *ends])) and all(x >= fim.LEAST for x in np.diff([0, *ends])[:-1])


def test_summaries_join_like_whole_texts():
    rng = random.Random(6)
    for _ in range(400):
        data = "".join(rng.choice(["a", " ", "\n", "é", "<", "P", ">", "<P>", "😀"]) for _ in range(rng.randint(2, 30))).encode()
        cuts = sorted(rng.sample(range(1, len(data)), min(len(data) - 1, rng.randint(1, 4))))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        whole = fim.summarise(parts[0])
        for part in parts[1:]:
            whole = whole.join(fim.summarise(part))
        assert whole == fim.summarise(data)
