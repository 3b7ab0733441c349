"""Joins whose hot keys are dealt over several tasks."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import broadcast_if_small, cut_lineage

#: Rows of one key on the left side that meet the right side in one task.
KEY_ROWS = 4096


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", key_rows: int = KEY_ROWS,
                sizes: DataFrame | None = None) -> DataFrame:
    """Equi join (inner, left, left_semi or left_anti) in which the left rows of a key with more than
    `key_rows` of them are dealt over salts and the key's right rows are copied to each salt, so that no
    task gets a key whole.  Keys are compared as by a plain join on columns of the same name.  `sizes`
    (keys, count) saves counting where the left rows of each key are known."""
    salts = F.ceil(F.col("count") / key_rows).cast("int")
    sizes = left.groupBy(*keys).count() if sizes is None else sizes
    hot = sizes.where(F.col("count") > key_rows).select(*keys, salts.alias("__salts"))
    if not hot.limit(1).count():
        return left.join(right, keys, how)
    hot = broadcast_if_small(cut_lineage(hot))
    last = F.coalesce("__salts", F.lit(1)) - 1
    hashed = [F.col(f"`{f.name}`") for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    dealt = left.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*hashed), last + 1).cast("int"))
    copied = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), last)))
    return dealt.drop("__salts").join(copied.drop("__salts"), [*keys, "__salt"], how).drop("__salt")
