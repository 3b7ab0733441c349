"""TXT8: a lemma dictionary learned from the words of a corpus.

A rule replaces a word ending by a shorter one ("ies" by "y", "s" by nothing).  Its support is the number of stems
that occur with both endings, its share the support divided by the stems that occur with the longer one.  A word's
lemma comes from the rule of the highest share (then support, then the first lemma) that leads to another word
of the corpus; words without such a rule are their own lemmas and are not listed.

Words are counted first, so a frequent word is one row from then on.  A stem meets only the `max_endings` endings
with the most stems, which bounds the pairs of a stem and the table of rules, the only tables that are broadcast.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import broadcast_if_small, cut_lineage

MIN_STEM, MAX_ENDING = 3, 4  # letters


def words_of(tokens: DataFrame) -> DataFrame:
    """(word, n) of a token table (..., lemma): lower-case words of letters only."""
    return tokens.where(F.col("lemma").rlike(r"^\p{L}+$")).groupBy(F.lower("lemma").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def _cuts(words: DataFrame) -> DataFrame:
    """(word, stem, ending): every cut that leaves a stem of MIN_STEM letters."""
    size = F.length("word")
    k = F.explode(F.sequence(F.lit(0), F.least(F.lit(MAX_ENDING), size - MIN_STEM))).alias("k")
    return words.where(size >= MIN_STEM).select("word", k).select(
        "word", F.expr("left(word, length(word) - k)").alias("stem"), F.expr("right(word, k)").alias("ending"))


def ending_rules(words: DataFrame, max_endings: int = 100, min_support: int = 3, min_share: float = 0.1) -> DataFrame:
    """(ending, base, support, share): rules that replace `ending` by the shorter `base`."""
    cuts = _cuts(words)
    endings = cut_lineage(cuts.groupBy("ending").agg(F.count(F.lit(1)).alias("stems")).orderBy(F.desc("stems"), "ending").limit(max_endings))
    stems = cuts.join(broadcast_if_small(endings.select("ending")), "ending").groupBy("stem").agg(F.collect_list("ending").alias("e"))
    pairs = stems.where(F.size("e") > 1).select("e", F.explode("e").alias("ending")).select("ending", F.explode("e").alias("base")) \
        .where(F.length("base") < F.length("ending"))
    support = pairs.groupBy("ending", "base").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
    share = F.col("support") / F.col("stems")
    return support.join(broadcast_if_small(endings), "ending").select("ending", "base", "support", share.alias("share")).where(F.col("share") >= min_share)


def lemma_dictionary(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(token_lower, lemma) of the words that a rule leads to another word, for `tables.lemmatize`."""
    to = _cuts(words).join(broadcast_if_small(rules), "ending").select(
        F.col("word").alias("token_lower"), F.concat("stem", "base").alias("word"), "support", "share")
    found = to.join(words.select("word"), "word", "left_semi")
    best = F.min(F.struct((-F.col("share")).alias("share"), (-F.col("support")).alias("support"), F.col("word").alias("lemma")))
    return found.groupBy("token_lower").agg(best.alias("b")).select("token_lower", F.col("b.lemma").alias("lemma"))


def learn(tokens: DataFrame, max_endings: int = 100, min_support: int = 3, min_share: float = 0.1) -> DataFrame:
    """The dictionary (token_lower, lemma) of a token table (..., lemma)."""
    words = cut_lineage(words_of(tokens))
    return lemma_dictionary(words, ending_rules(words, max_endings, min_support, min_share))
