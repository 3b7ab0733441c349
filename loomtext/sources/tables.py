"""Sources (SRC*): parquet tables, question corpora and the derived dimension tables
(keyword list, background frequency, stop list, deterministic word vectors)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# A short English function-word list used as the default stop list seed.
# (The question words in text.KEEP_QUESTION_WORDS are removed from it, as the reference does.)
ENGLISH_STOP_SEED = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have",
    "he", "her", "his", "i", "in", "is", "it", "its", "of", "on", "or", "she", "that",
    "the", "their", "they", "this", "to", "was", "we", "were", "will", "with", "you",
    "what", "when", "who", "where", "why", "how",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The files of a table as a stream; a table is one parquet file or a folder of them."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a path without a pattern would become the base path of the files, which must be a folder
    return reader.parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def documents_as_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1 shape (id, question, corpus_id) from `documents`; corpus = language."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("question"), F.col("lang").alias("corpus_id")
    )


def turns_as_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts: all turns of `conversations`; id = conv_id*1000+turn, corpus = conv_id."""
    return (
        table(spark, sf_dir, "conversations")
        .select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
            F.col("text").alias("question"),
            F.col("conv_id").alias("corpus_id"),
        )
    )


def string_array_json(spark: SparkSession, path: str, field: str = "questions", multi_line: bool = True) -> DataFrame:
    """SRC4: `{questions:[str,...]}` -> (id = 0-based position, question).  A long list may be cut into objects
    of one line each (multi_line False), which give the position of their first element as `first`."""
    raw = spark.read.option("multiLine", multi_line).schema(f"{field} ARRAY<STRING>, first BIGINT").json(path)
    at = F.coalesce("first", F.lit(0)).alias("first")
    return raw.select(at, F.posexplode(field).alias("id", "question")).select((F.col("first") + F.col("id")).alias("id"), "question")


def token_table(questions: DataFrame, id_col: str = "id", text_col: str = "question",
                clean: bool = True, punctuation: bool = False) -> DataFrame:
    """TXT2/TXT1/TXT3 -> TXT6 -> TXT8: long table (id, pos, token, lemma); with `punctuation` every
    other visible character is a token of its own."""
    txt = T.question_text(text_col) if clean else F.col(text_col)
    found = F.regexp_extract_all(txt, F.lit(f"[{T.WORD_CHARS}]+|[^{T.WORD_CHARS}\\s]"), 0) if punctuation else T.tokens(txt)
    return questions.select(
        F.col(id_col).alias("id"), F.posexplode(found).alias("pos", "token")
    ).withColumn("lemma", F.lower("token"))


def lemmatize(tokens: DataFrame, lemma_dict: DataFrame | None) -> DataFrame:
    """TXT8 with a dictionary (token_lower, lemma): broadcast left join, identity fallback."""
    if lemma_dict is None:
        return tokens
    from loomtext.session import broadcast_if_small

    d = broadcast_if_small(lemma_dict.select(F.col("token_lower"), F.col("lemma").alias("_lemma")))
    return (
        tokens.join(d, F.lower(tokens["token"]) == d["token_lower"], "left")
        .withColumn("lemma", F.coalesce("_lemma", F.lower("token")))
        .drop("_lemma", "token_lower")
    )


def background_frequency(tokens: DataFrame) -> DataFrame:
    """SRC5: (lemma, cnt, freq) = occurrences / all occurrences over a background corpus.
    The total is one scalar aggregate; no single-partition window."""
    counts = tokens.groupBy("lemma").agg(F.count(F.lit(1)).alias("cnt"))
    total = tokens.agg(F.count(F.lit(1))).first()[0] or 1
    return counts.withColumn("freq", F.col("cnt") / F.lit(float(total)))


def document_frequency(tokens: DataFrame) -> DataFrame:
    """AG2: (lemma, df) = number of documents containing the lemma."""
    return tokens.select("id", "lemma").distinct().groupBy("lemma").agg(F.count(F.lit(1)).alias("df"))


def lemma_documents(docs: DataFrame, *keys: str) -> DataFrame:
    """AG2 of documents (keys.., id, lemmas ARRAY<STRING>): (keys.., lemma, df), the distinct ids with the lemma.
    A document whose id occurs once is counted where it is read, so that partial counts are shuffled and not
    (id, lemma) rows; only the rows of repeated ids are made distinct by a shuffle."""
    from loomtext.session import broadcast_if_small, cut_lineage

    rows = docs.select(*keys, "id", F.array_distinct("lemmas").alias("lemmas"))
    count = lambda df: df.groupBy(*keys, "lemma").agg(F.count(F.lit(1)).alias("df"))
    repeated = cut_lineage(docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("id").alias("_id")))
    if not repeated.limit(1).count():
        return count(rows.select(*keys, F.explode("lemmas").alias("lemma")))
    again, same = broadcast_if_small(repeated), F.col("id").eqNullSafe(F.col("_id"))
    once = count(rows.join(again, same, "left_anti").select(*keys, F.explode("lemmas").alias("lemma")))
    more = count(rows.join(again, same, "left_semi").select(*keys, "id", F.explode("lemmas").alias("lemma")).distinct())
    return once.unionByName(more).groupBy(*keys, "lemma").agg(F.sum("df").alias("df"))


def derived_keywords(df: DataFrame, n_docs: int, how_many: int = 20) -> DataFrame:
    """SRC3 fixture, from document frequencies (lemma, df): `how_many` lemmas of >= 4 characters whose document frequency lies in
    [1 %, 20 %] of the documents, rarest first (df, lemma)."""
    from pyspark.sql import Window

    top = (
        df.where(F.length("lemma") >= 4).where((F.col("df") >= F.lit(0.01 * n_docs)) & (F.col("df") <= F.lit(0.2 * n_docs)))
        .orderBy("df", "lemma")
        .limit(how_many)
    )
    # numbering the `how_many` selected rows (a bounded list) gives the keyword order
    return top.select(F.col("lemma").alias("keyword"),
                      F.row_number().over(Window.orderBy("df", "lemma")).alias("kw_pos"))


def derived_stop_list(df: DataFrame, per_lang: int = 30) -> DataFrame:
    """Stop list fixture, from document frequencies (lang, lemma, df): the `per_lang` highest-df lemmas per corpus language, plus the English
    seed list, minus the question words (TXT11)."""
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.col("df").desc(), F.col("lemma"))
    top = df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_lang).select("lemma")
    seed = df.sparkSession.createDataFrame([(w_,) for w_ in ENGLISH_STOP_SEED], "lemma string")
    keep = df.sparkSession.createDataFrame([(w_,) for w_ in T.KEEP_QUESTION_WORDS], "lemma string")
    return top.unionByName(seed).distinct().join(keep, "lemma", "left_anti")


def md5_word_vector(word_col, dims: int = 16):
    """SRC6 fixture: deterministic word vector, dim i = byte i of md5(word)/255 - 0.5."""
    h = F.md5(word_col)
    return F.array(*[
        (F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("double") / 255.0 - 0.5) for i in range(dims)
    ])


def token_flags(tokens: DataFrame, stop: DataFrame | None, vocabulary: DataFrame | None) -> DataFrame:
    """TXT10: adds is_stop (stop-list join), is_punct (no word character) and is_oov (no entry in
    the vector vocabulary) to a token table (..., token, lemma).  Both lists are joined by key
    (broadcast only behind the size guard)."""
    from loomtext.session import broadcast_if_small

    out = tokens
    if stop is not None:
        s = broadcast_if_small(stop.select("lemma").distinct().withColumn("_s", F.lit(True)))
        out = out.join(s, "lemma", "left")
    else:
        out = out.withColumn("_s", F.lit(None).cast("boolean"))
    if vocabulary is not None:
        v = vocabulary.select("lemma").distinct().withColumn("_v", F.lit(True))
        out = out.join(v, "lemma", "left")
    else:
        out = out.withColumn("_v", F.lit(True))
    return out.withColumn("is_stop", F.coalesce("_s", F.lit(False))) \
        .withColumn("is_punct", ~F.col("token").rlike(f"[{T.WORD_CHARS}]")) \
        .withColumn("is_oov", F.col("_v").isNull()).drop("_s", "_v")


def remove_stopwords(tokens: DataFrame) -> DataFrame:
    """TXT12 on a flagged token table."""
    return tokens.where(~F.col("is_stop"))


def union_corpus(*texts: DataFrame) -> DataFrame:
    """TXT19 / SO4: one text table from several (id, question) tables, keyed by source index."""
    out = None
    for i, t in enumerate(texts):
        t = t.select(F.lit(i).alias("src"), "id", "question")
        out = t if out is None else out.unionByName(t)
    return out


#: Content tags kept by default; labels also keep adjectives.
CONTENT_TAGS = ("NOUN", "PROPN", "VERB")


def content_words(tokens: DataFrame, lexicon: DataFrame | None, tags: tuple[str, ...] = CONTENT_TAGS,
                  ignore_pos: bool = False) -> DataFrame:
    """TXT13: rows of a token table (..., lemma) whose lemma has one of `tags` in `lexicon`
    (lemma, tag); all rows with `ignore_pos` or without a lexicon."""
    if lexicon is None or ignore_pos:
        return tokens
    listed = lexicon.where(F.col("tag").isin(*tags)).select("lemma").distinct()
    return tokens.join(listed, "lemma", "left_semi")


def question_request(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """SRC1: request bodies `{questions: [{id, question}], keywords: [..]?}` ->
    ((id, question), (keyword, kw_pos)); kw_pos is the place in its list.  A body is a file, or a line
    with multi_line=False (so that many bodies are read in parallel)."""
    raw = spark.read.option("multiLine", multi_line).schema(
        "questions ARRAY<STRUCT<id: LONG, question: STRING>>, keywords ARRAY<STRING>").json(path)
    return (raw.select(F.inline("questions")),
            raw.select(F.posexplode("keywords").alias("kw_pos", "keyword")).select("keyword", (F.col("kw_pos") + 1).alias("kw_pos")))


def typed_questions(records: DataFrame, json_col: str) -> DataFrame:
    """SRC2: valid JSON records -> (question STRING, question_id LONG, course_id STRING)."""
    from loomtext.sources.validate import check_records

    ok = check_records(records, json_col).where(F.col("error_code").isNull())
    v = F.parse_json(F.col(json_col))
    get = lambda name, kind: F.variant_get(v, f"$.{name}", kind).alias(name)
    return ok.select(get("question", "string"), get("question_id", "bigint"), get("course_id", "string"))
