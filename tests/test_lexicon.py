from loomtext.operators import lexicon as LX
from loomtext.sources import tables as S


def _tokens(spark, words):
    return spark.createDataFrame([(1, i, w, w) for i, w in enumerate(words)], "id long, pos int, token string, lemma string")


STEMS = ["walk", "talk", "jump", "look"]


def test_learned_endings(spark):
    words = STEMS + [w + "s" for w in STEMS] + [w + "ing" for w in STEMS] * 3 + ["party", "parties", "city", "cities", "copy", "copies", "king", "123s", "it"]
    got = {r.token_lower: r.lemma for r in LX.learn(_tokens(spark, words)).collect()}
    want = {w + e: w for w in STEMS for e in ("s", "ing")} | {"parties": "party", "copies": "copy"}
    for word, lemma in want.items():
        assert got[word] == lemma, word
    assert "king" not in got and "123s" not in got and "walk" not in got


def test_equals_plain_counts(spark):
    words = sorted(set(STEMS + [w + "s" for w in STEMS[:3]] + [w + "er" for w in STEMS] + ["walkers", "talkers", "lookers", "jumper"]))
    rules = {(r.ending, r.base): (r.support, round(r.share, 9)) for r in LX.ending_rules(
        LX.words_of(_tokens(spark, words)), min_support=1, min_share=0.0).collect()}
    cuts = {(w[:len(w) - k], w[len(w) - k:]) for w in words for k in range(5) if len(w) - k >= 3}
    stems, plain = {}, {}
    for stem, e in cuts:
        stems[e] = stems.get(e, 0) + 1
        for stem2, b in cuts:
            if stem2 == stem and len(b) < len(e):
                plain[e, b] = plain.get((e, b), 0) + 1
    assert rules == {(e, b): (n, round(n / stems[e], 9)) for (e, b), n in plain.items()}


def test_no_words_and_words_without_a_rule(spark):
    assert LX.learn(_tokens(spark, ["12", "??", "ab"])).count() == 0
    toks = _tokens(spark, ["Alpha", "beta"])
    assert sorted(r.lemma for r in S.lemmatize(toks, LX.learn(toks)).collect()) == ["alpha", "beta"]
