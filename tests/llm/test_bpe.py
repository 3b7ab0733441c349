import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from loomtext.llm import bpe
from helpers import docs, odd_texts

RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
PLAIN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("chars, size", [(1 << 14, 24), (1, 1), (5, 2), (64, 7)])
def test_tree_reduction_equals_direct_encoding(chars, size):
    encoder, rng = bpe.Encoder(RANKS, P.PATTERN, chars, size), random.Random(chars)
    known = list(RANKS)
    for i in range(1500):
        if i % 3:
            text = "".join(rng.choice("ab'rellvs  \n\t12é!?.日ß😀 \x1c ") for _ in range(rng.randint(0, 40)))
        else:
            text = b"".join(rng.choice(known) for _ in range(rng.randint(0, 8))).decode("utf-8", "ignore")
        ids = np.frombuffer(encoder.encode(text), "<u4")
        assert ids.tolist() == PLAIN.encode_ordinary(text), repr(text)
        assert encoder.decode(ids, leaf=3) == text.encode()


def test_long_match_and_full_table(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    encoder = bpe.Encoder(RANKS, P.PATTERN)
    text = "xyzzy" * 3000 + " a b c d e f g h i j " * 3
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == PLAIN.encode_ordinary(text)
    assert len(encoder) <= 5


def test_documents(spark):
    given = odd_texts()
    got = bpe.round_trip(docs(spark, given), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    want = [(-1 if i is None else i, PLAIN.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in given]
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got) == sorted(want)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert bpe.round_trip(docs(spark, []), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
