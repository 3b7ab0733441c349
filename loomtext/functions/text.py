"""Scalar text functions (TXT*) as JVM-side Column expressions.

Every function returns a `Column`, so it stays inside whole-stage codegen.  Character classes
are spelled out with Unicode properties because Java's `\\w` is ASCII-only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must match the reference's behaviour.
WORD_CHARS = r"\p{L}\p{N}\p{M}_"  # Unicode word characters (letters, numbers, marks, underscore)
ESCAPED_TAG = r"&lt;/?.*?&gt;"  # an escaped html tag
TAG_PLACEHOLDER = "&lt;&gt;"
KEEP_QUESTION_WORDS = ["what", "when", "who", "where", "why", "how"]  # removed from stop lists

TOKEN_PATTERN = f"[{WORD_CHARS}]+"
SENTENCE_SPLIT = r"[.!?]+\s+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col, lower: bool = False) -> Column:
    """TXT1: optional lower; apostrophe -> space; escaped tags -> placeholder;
    drop everything except word characters and plain spaces."""
    c = _c(col)
    if lower:
        c = F.lower(c)
    c = F.replace(c, F.lit("'"), F.lit(" "))
    c = F.regexp_replace(c, ESCAPED_TAG, TAG_PLACEHOLDER)
    return F.regexp_replace(c, f"[^{WORD_CHARS} ]", "")


def strip_newlines(col) -> Column:
    """TXT2: newline removed (joins the words on both sides)."""
    return F.replace(_c(col), F.lit("\n"), F.lit(""))


def empty_to_space(col) -> Column:
    """TXT3: empty text becomes one space."""
    c = _c(col)
    return F.when(F.length(c) == 0, F.lit(" ")).otherwise(c)


def question_text(col) -> Column:
    """TXT2 + TXT1 + TXT3: the question cleaning of the tagged corpus."""
    return empty_to_space(clean_text(strip_newlines(col)))


def lower_trim(col) -> Column:
    """TXT4."""
    return F.trim(F.lower(_c(col)))


def pre_process(col) -> Column:
    """TXT5: lower; tags -> ' &lt;&gt; '; runs of digits / non-word characters -> one space."""
    c = F.regexp_replace(F.lower(_c(col)), ESCAPED_TAG, " " + TAG_PLACEHOLDER + " ")
    return F.regexp_replace(c, r"([^\p{L}\p{Nl}\p{No}\p{M}_])+", " ")


def tokens(col) -> Column:
    """TXT6: word tokens in order (ARRAY<STRING>)."""
    return F.regexp_extract_all(_c(col), F.lit(TOKEN_PATTERN), 0)


def lemmas(col) -> Column:
    """TXT8 without a dictionary: the lemma of a token is its lower-case form."""
    return F.transform(tokens(col), lambda t: F.lower(t))


def sentences(col) -> Column:
    """TXT7: sentence split on terminal punctuation followed by white space."""
    return F.split(_c(col), SENTENCE_SPLIT)


def _shifted_grams(w: Column, n: int) -> Column:
    """All (repeating) n-grams of an array column, in order.  Built from shifted slices and
    `zip_with`, so the input expression is never captured inside a lambda (a lambda would
    re-evaluate it once per element)."""
    if n == 1:
        return w
    length = F.greatest(F.size(w) - n + 1, F.lit(0))
    g = F.slice(w, 1, length)
    for k in range(1, n):
        g = F.zip_with(g, F.slice(w, k + 1, length), lambda a, b: F.concat(a, F.lit(" "), b))
    return g


def ngrams(words, n: int) -> Column:
    """TXT15: distinct space-joined n-grams of an array column, first-occurrence order."""
    return F.array_distinct(_shifted_grams(_c(words), n))


def word_ngrams_1_to_3(words) -> Column:
    """TXT16 (word analyzer): all 1..3-grams (with repeats, for term counting)."""
    w = _c(words)
    return F.concat(_shifted_grams(w, 1), _shifted_grams(w, 2), _shifted_grams(w, 3))


def char_ngrams_1_to_3(col) -> Column:
    """TXT16 (char analyzer): white space collapsed, then all character 1..3-grams."""
    chars = F.split(F.regexp_replace(_c(col), r"\s\s+", " "), "")
    chars = F.when(F.size(chars) == 1, F.filter(chars, lambda x: F.length(x) > 0)).otherwise(chars)
    return F.concat(_shifted_grams(chars, 1), _shifted_grams(chars, 2), _shifted_grams(chars, 3))


def char_ngrams_of_chars(chars) -> Column:
    """Character 1..3-grams of an array of characters."""
    c = _c(chars)
    return F.concat(_shifted_grams(c, 1), _shifted_grams(c, 2), _shifted_grams(c, 3))


def label_type(col) -> Column:
    """TXT17: 2 for a label containing a space (2-gram), else 1."""
    return F.when(F.instr(_c(col), " ") > 0, F.lit(2)).otherwise(F.lit(1))


def pair_row(n, pos) -> Column:
    """TXT18 row of the 1-based position `pos` in the row-major strict upper triangle of n x n."""
    n, pos = _c(n).cast("long"), _c(pos).cast("long")  # m * m leaves 32 bits beyond 23,170 rows
    m = 2 * n - 1
    return F.floor((m - F.sqrt(m * m - 8 * (pos - 1))) / 2).cast("long")


def pair_col(n, pos) -> Column:
    """TXT18 column for the same position."""
    n, pos = _c(n).cast("long"), _c(pos).cast("long")
    r = pair_row(n, pos)
    return (pos - 1 - F.floor(r * (2 * n - r - 1) / 2) + r + 1).cast("long")


def l2_normalize(vec) -> Column:
    """TXT20: zero-safe L2 normalisation of an ARRAY<DOUBLE>."""
    v = _c(vec)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    # the norm is passed as an argument (array_repeat), not captured by a lambda
    scaled = F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, m: x / m)
    return F.when(norm == 0, v).otherwise(scaled)


#: Word lists up to this length become a hashed set inside the expression; longer ones are joined.
LITERAL_WORDS = 10_000


def without_words(df: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """`df` with the words of the one-column table `words` removed from the array `column`, order kept."""
    found = [r[0] for r in words.distinct().limit(LITERAL_WORDS + 1).collect()]
    if len(found) <= LITERAL_WORDS:
        return df.withColumn(column, F.filter(column, lambda t: ~t.isin(found))) if found else df
    rest = [c for c in df.columns if c != column]
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    each = rows.select("_row", *rest, F.posexplode_outer(column).alias("_pos", "_word"))
    listed = words.distinct().select(F.col(words.columns[0]).alias("_word"), F.lit(True).alias("_listed"))
    marked = each.join(listed, "_word", "left")
    kept = F.collect_list(F.when(F.col("_listed").isNull() & F.col("_word").isNotNull(), F.struct("_pos", "_word")))
    out = marked.groupBy("_row").agg(*(F.first(c).alias(c) for c in rest), F.sort_array(kept).alias(column))
    return out.select(*(F.transform(column, lambda e: e["_word"]).alias(c) if c == column else F.col(c) for c in df.columns))
