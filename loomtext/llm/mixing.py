"""Mixing sources to target weights by entropy balancing.

The mix keeps every document's rate as close as possible (in relative entropy) to one copy while
each source's tokens meet their target: minimise sum_d r_d log r_d - r_d subject to
sum_{d in s} size_d r_d = target_s and 0 <= r_d <= cap.  The convex dual has one multiplier per
source, and the rates are exponentially tilted, r_d = min(cap, exp(lambda_s size_d / mean_s)).
Newton's iterations on the dual run as one aggregation per round over the table of (source, size)
classes, since documents of one source and size share their rate; a bracket guards each step.

Rounding.  Rates are rounded over the classes of a source in order of size (cumulative floors, so
that errors cancel between neighbours of nearly equal size); then the one copy whose addition or
removal brings the source nearest to its target is added or removed, until no copy brings any nearer.  Inside a class the
copies go to documents in the order of a hash of their id, dealt over hash cells of bounded size.
All parts are DataFrame operations, and the result does not depend on partitioning.

A null text has size 0; a null source is a source of its own, last in order.  A source without
words has target 0; its documents keep one copy each (they hold no words).  Repeated rows count
row by row.  Empty tables give empty results.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm import common as C

#: Members of a class that are ranked together.
CELL = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> with `target`: the share of all tokens dealt by weight, none above
    `cap` times its source's size, the excess dealt again by weight.  Sources by code point (null
    last) take the weights in turn."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", turn.cast("double")).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    # Sources fill up in the order of limit / weight.  With the first k of them full, the rest get
    # (total - limits of the k) / (weights of the rest) per unit of weight; the first k whose level
    # lies below the next source's ratio is where the dealing ends.
    fills = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, rest = fills.rowsBetween(Window.unboundedPreceding, -1), fills.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                     / F.sum("weight").over(rest))
    s = s.withColumn("place", F.row_number().over(fills))
    ends = F.when(F.col("level") < F.col("limit") / F.col("weight"), F.col("place"))
    s = s.withColumn("level", F.min_by("level", ends).over(whole))
    return s.withColumn("target", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), "limit"))).drop("limit", "weight", "level", "place")


def _rate(cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("x"), F.lit(50.0))))


def multipliers(classes: DataFrame, goals: DataFrame, cap: float, tolerance: float, rounds: int = 200) -> DataFrame:
    """(source, lam, mean): Newton on the dual; classes (source, size, n), goals (source, target, mean)."""
    state = goals.select("source", "target", "mean", F.lit(0.0).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"))
    for _ in range(rounds):  # a step that leaves its bracket halves it, so the rounds suffice for the last bit
        rows = classes.join(state, classes["source"].eqNullSafe(state["source"])).drop(classes["source"])
        rows = rows.withColumn("x", F.col("size") / F.col("mean")).withColumn("r", _rate(cap))
        tokens = F.col("n") * F.col("size") * F.col("r")
        step = rows.groupBy("source", "target", "mean", "lam", "lo", "hi").agg(
            F.sum(tokens).alias("got"), F.sum(F.when(F.col("r") < cap, tokens * F.col("x")).otherwise(0.0)).alias("slope"))
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
        done = (F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))) | (hi - lo < 1e-12)
        state = C.materialise(step.select(
            "source", "target", "mean", F.when(done, F.col("lam")).when(inside, newton).otherwise((lo + hi) / 2).alias("lam"),
            lo.alias("lo"), hi.alias("hi"), done.alias("done")))
        if not state.where("not done").limit(1).count():
            break
        state = state.drop("done")
    return state.select("source", "mean", F.round("lam", 9).alias("lam"))


def _corrected(k: DataFrame, cap: int) -> DataFrame:
    """(source, size, n, target, k, moved) with one copy added to or taken from the class of each source that
    brings it nearest to its target, if any does."""
    of_source = Window.partitionBy("source")  # classes: as many rows as sizes occur
    gap = F.max("target").over(of_source) - F.sum(F.col("k") * F.col("size")).over(of_source)
    c = k.withColumn("gap", gap).withColumn("sign", F.signum("gap").cast("long"))
    after = F.abs(F.col("gap") - F.col("sign") * F.col("size"))
    may = (F.col("size") > 0) & (F.col("k") + F.col("sign")).between(F.lit(0), F.col("n") * cap) & (after < F.abs("gap"))
    c = c.withColumn("best", F.min(F.when(may, F.struct(after.alias("after"), "size"))).over(of_source))
    return c.select("source", "size", "n", "target", (F.col("k") + F.when(F.col("best.size") == F.col("size"), F.col("sign"))
                                                      .otherwise(0)).alias("k"), F.col("best").isNotNull().alias("moved"))


def mix(docs: DataFrame, weights: tuple = (3.0, 1.0, 2.0), share: float = 1.5, cap: int = 2, tolerance: float = 1e-9) -> DataFrame:
    """(doc_id, source, text) -> (doc_id, source, size, source_size, target, copies)."""
    rows = C.materialise(docs.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("size")))
    classes = C.materialise(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    sources = C.materialise(targets(sources, list(weights), share, cap))
    # a source whose target is its limit takes every document `cap` times; a wordless one has nothing to balance
    goals = sources.where(F.col("target") < cap * F.col("source_size")).select(
        "source", "target", (F.col("source_size") / F.col("docs")).alias("mean"))
    lam = multipliers(classes, goals, cap, tolerance)

    # cumulative floors over the sizes of a source (as many rows as sizes occur)
    priced = classes.join(lam.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    known = sources.select(F.col("source").alias("of"), "source_size", "target")
    priced = priced.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    full = F.when(F.col("source_size") > 0, float(cap)).otherwise(1.0)
    priced = priced.withColumn("x", F.col("size") / F.col("mean")).withColumn(
        "r", F.when(F.col("lam").isNotNull(), _rate(cap)).otherwise(full))
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.floor(F.sum(F.col("n") * F.col("r")).over(by_size) + F.lit(0.5))
    copies = F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy("size")), F.lit(0))
    k = priced.withColumn("upto", upto).select(
        "source", "size", "n", "target", F.least(F.greatest(copies, F.lit(0)), F.col("n") * cap).alias("k"))
    while True:  # every step brings the words of a source, a whole number, nearer to its target: this ends
        k = C.materialise(_corrected(k, cap))
        if not k.where("moved").limit(1).count():
            break

    # copies of a class are dealt over its cells, then over the documents of a cell
    k = k.select(F.col("source").alias("of"), F.col("size").alias("in"), "n", "k", F.ceil(F.col("n") / CELL).alias("cells"))
    mine = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("in"))
    placed = rows.join(k, mine).drop("of", "in").withColumn("h", F.xxhash64(F.lit("mix"), "doc_id"))
    placed = C.materialise(placed.withColumn("cell", F.pmod("h", F.col("cells"))))
    cells = placed.groupBy("source", "size", "cell", "n", "k").agg(F.count("*").alias("m"))
    in_class = Window.partitionBy("source", "size").orderBy("cell")
    so_far = F.sum("m").over(in_class.rowsBetween(Window.unboundedPreceding, 0))
    dealt = cells.withColumn("upto", F.floor(so_far * F.col("k") / F.col("n"))).withColumn(
        "mine", F.col("upto") - F.coalesce(F.lag("upto").over(in_class), F.lit(0)))
    dealt = dealt.select(F.col("source").alias("of"), F.col("size").alias("in"), F.col("cell").alias("c"), "m", "mine")
    rank = F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("h", "doc_id"))
    out = placed.join(dealt, mine & (F.col("cell") == F.col("c"))).withColumn("rank", rank)
    each = F.floor(F.col("mine") / F.col("m")) + F.when(F.col("rank") <= F.pmod("mine", "m"), 1).otherwise(0)
    out = out.select("doc_id", "source", "size", F.least(each, F.lit(cap)).cast("int").alias("copies"))
    return out.join(known, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", "copies")
