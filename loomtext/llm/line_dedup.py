"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by the host's pages; lines above
`max_ratio` (and on `min_pages` pages at least) are boilerplate and are dropped from every page of
that host.  Pages of a host whose whole text is the same count as one page, so copies of a page do
not turn its content into boilerplate.  Lines without a word are neither counted nor dropped.

Counting runs in two steps: (host, 64-bit hash of the line) with partial sums finds the candidates,
then the candidates' lines are counted by their text, so a hash collision drops nothing.  A host
cannot have more than (its mean lines per page) / max_ratio boilerplate lines, which bounds the list
joined to its pages; the list is broadcast if a count proves it small, else pages and lists meet over
salts, so a host with a third of all rows is spread.

A null text gives an empty one, a null host is a host of its own.  Rows are told apart by their host
and text alone: ids may be null or repeated, repeated rows are one page, and rows that share an id but
not the text are pages of their own.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm import common as C

SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _has_word(line: Column) -> Column:
    return line.rlike(C.WORD)


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """(site, text) -> (site, lines): the boilerplate lines of each site."""
    whole = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    pages = pages.withColumn("whole", whole)
    copies = C.materialise(pages.groupBy("site", "whole").agg(F.count("*").alias("n"))
                           .where("n > 1").select("site", "whole", F.lit(True).alias("copied")))
    marked = C.join_small(pages, copies, ["site", "whole"])
    first = marked.where("copied").groupBy("site", "whole").agg(F.first("text").alias("text"))  # all texts of a group are the same
    once = marked.where("copied is null").select("site", "text").union(C.materialise(first.select("site", "text")))
    line = F.explode(F.array_distinct(F.filter(_lines(F.col("text")), _has_word))).alias("line")
    total = C.materialise(pages.groupBy("site", "whole").count().groupBy("site").agg(F.count("*").alias("pages")))
    often = (F.col("n") >= min_pages) & (F.col("n") > max_ratio * F.col("pages"))
    lines = once.select("site", line)
    hashed = lines.select("site", F.xxhash64("line").alias("h")).groupBy("site", "h").agg(F.count("*").alias("n"))
    maybe = C.materialise(hashed.where(F.col("n") >= min_pages).join(total, "site").where(often).select("site", "h"))
    exact = C.join_small(lines.withColumn("h", F.xxhash64("line")), maybe, ["site", "h"], "left_semi")
    exact = exact.groupBy("site", "line").agg(F.count("*").alias("n")).join(total, "site").where(often)
    return exact.groupBy("site").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, id_col: str, host: Column, max_ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """(row, text, n_lines, n_dropped): `row` holds all columns of a page, `text` its cleaned text."""
    site = F.coalesce(F.concat(F.lit("h:"), host.cast("string")), F.lit("none"))
    keyed = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), F.col(id_col).alias("id"),
                         site.alias("site"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = C.materialise(boilerplate(keyed.select("site", "text"), max_ratio, min_pages))
    found = found.withColumnRenamed("lines", "drop")
    if found.agg(F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()[0] <= C.BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(found), "site", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("id", "text"), F.lit(SALTS)).cast("int")).join(salted, ["site", "salt"], "left")
    lines = _lines(F.col("text"))
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("drop", x)))
    words = lambda x: F.size(F.filter(x, _has_word)).cast("long")
    return joined.select("row", words(lines).alias("n_lines"), (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"),
                         F.array_join(kept, "\n").alias("text"))


#: Tags that end a line of a page, and parts without visible text.
BLOCK = r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)([\s/][^>]*)?>"
HIDDEN = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, host, text): one visible line per block of the page."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), HIDDEN, ""), BLOCK, "\n"), TAG, "")
    return pages.select("page_id", F.lower(F.regexp_extract("url", HOST, 1)).alias("host"),
                        F.trim(F.regexp_replace(text, r"[ \t\r]*\n\s*", "\n")).alias("text"))
