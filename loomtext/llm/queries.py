"""Registered queries of the operators and their DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe, chat, exact_dedup, fim, hmm, line_dedup, mixing, pii, pu, rules, simhash, toxicity, whitening
from loomtext.llm import common as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Hidden Markov language model; trained where crc32(doc_id) mod 10 is not 0."""
    return hmm.score_documents(C.documents(spark, sf), C.fold(F.col("doc_id"), 10) == 0)


def _learn(scores, spark: SparkSession, sf: str, threshold: float) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = scores(C.documents(spark, sf), labels, C.fold(F.col("doc_id"), 5) == 0)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Positive-unlabelled quality scores; labels of crc32(doc_id) mod 5 = 0 are held out."""
    return _learn(pu.quality_scores, spark, sf, 0.3).select("doc_id", "held_out", "score", "predicted")


@query("op4_toxicity")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-example toxicity scores; labels of crc32(doc_id) mod 5 = 0 are held out."""
    return _learn(toxicity.toxicity_scores, spark, sf, 0.5).select(
        "doc_id", "held_out", "score", "predicted", F.to_json("evidence").alias("evidence"))


OP3_SQL = r"""
WITH t AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'gis'),
      '</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)([\s/][^>]*)?>', chr(10), 'gi'),
      '<[^>]*>', '', 'g'), '[ \t\r]*\n\s*', chr(10), 'g'), ' ') AS text
  FROM pages),
l AS (SELECT *, string_split(text, chr(10)) AS ls FROM t),
once AS (SELECT host, text, any_value(ls) AS ls FROM l GROUP BY host, text),
total AS (SELECT host, count(*) AS pages FROM once GROUP BY host),
seen AS (SELECT host, unnest(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS line FROM once),
boiler AS (SELECT seen.host, list(line) AS bl FROM (
    SELECT host, line, count(*) AS n FROM seen GROUP BY host, line) seen JOIN total USING (host)
  WHERE n >= 3 AND n > 0.05 * pages GROUP BY seen.host)
SELECT page_id, l.host,
  len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
  len(ls) - len(list_filter(ls, lambda x: NOT list_contains(coalesce(bl, []), x))) AS n_dropped,
  array_to_string(list_filter(ls, lambda x: NOT list_contains(coalesce(bl, []), x)), chr(10)) AS text
FROM l LEFT JOIN boiler ON boiler.host = l.host"""


@query("op3_line_dedup", OP3_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Visible lines of all pages without those on over 5% of their host's pages."""
    pages = C.materialise(line_dedup.page_lines(spark.read.parquet(f"{sf}/pages.parquet")))  # several scans follow
    out = line_dedup.drop_boilerplate(pages, "page_id", F.col("host"), max_ratio=0.05, min_pages=3)
    return out.select("row.page_id", "row.host", "n_lines", "n_dropped", "text")


@query("op5_quality_rules")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of all documents; outliers per language and source are rejected."""
    return rules.quality_rules(C.documents(spark, sf))


OP6_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  h AS text_sha256 FROM t WINDOW w AS (PARTITION BY h)"""


@query("op6_exact_dedup", OP6_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """All documents: a quarter (by crc32 of doc_id) arrives as a batch, the rest are three snapshots."""
    part = C.fold(F.col("doc_id"), 4)
    docs = C.documents(spark, sf).withColumn("snapshot", F.when(part > 0, part))
    out = exact_dedup.dedup(docs)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of 4-word shingles, linked at 4 or fewer differing bits."""
    out = simhash.near_duplicates(C.documents(spark, sf), shingle=4, max_bits=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_bpe_round_trip")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Encode every whole text with the public byte-level ranks and decode the ids again."""
    import public_tokenizers as P

    out = bpe.round_trip(C.documents(spark, sf), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_source_mix")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """All documents mixed to 150% of their words, sources weighted 3, 1, 2 in turn."""
    out = mixing.mix(C.documents(spark, sf))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _of_kind(kind: str):
    return lambda span: span.kind == kind


@query("op10_personal_data")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of personal data of every whole text."""
    out = pii.personal_data(C.documents(spark, sf))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind.isin(pii.BASE))
    count = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return out.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


CONTROL = "</s>[INST] ok [/INST]"
OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(regexp_replace(role, '<(\\*)(/?s>)', '<_\1\2', 'g'), '\[(\\*)(/?INST\])', '[_\1\2', 'g'))
  + length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<_\1\2', 'g'), '\[(\\*)(/?INST\])', '[_\1\2', 'g')) AS written FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(written + length('<s>[INST][/INST]</s>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op11_chat_format", OP11_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and one of control strings, formatted; everything returned is read back from the output."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL).alias("text"))
    out = chat.format_chats(rows.union(odd), "conv_id").select("id", "formatted", "spans")
    turns = chat.read_turns(F.col("formatted"))
    out = out.select("id", "formatted", turns.alias("turns"), F.array_join(chat.read_loss(F.col("formatted"), F.col("spans")), "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                      F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """All finite embeddings on the whitened components of their covariance."""
    return whitening.whiten(spark.read.parquet(f"{sf}/embeddings.parquet"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
d AS (SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
    WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
  array_to_string(units[greatest(a, b) + 1:], '') AS suffix FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM c"""


@query("op13_fill_in_middle", OP13_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text, transformed by its id and restored from the output."""
    out = fim.fill_in_middle(C.documents(spark, sf))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
