"""All-pairs work inside a corpus, done block by block (SIM1, AG11, JN11, JN12, SIL1, SP1 keys).

A corpus of n points is cut into ceil(n / block_rows) hash blocks; every point is sent to the
block pairs (bi <= bj) it belongs to and one Arrow task per block pair computes the distances
of its two blocks with numpy.  A task only emits what the operator needs (k nearest, sums,
pairs below a radius, histogram-ready keys), never the distance matrix, so a corpus holding a
third of all rows is spread over (#blocks)^2 / 2 tasks instead of one.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import broadcast_if_small, cut_lineage, share_if_small

#: Points of a block: each is sent to all blocks of its corpus, and a task holds the distances of two blocks.
BLOCK_ROWS = 1024


def blocked(points: DataFrame, block_rows: int = BLOCK_ROWS, blocks: DataFrame | None = None) -> DataFrame:
    """points (corpus, id, vec, ...) -> + blk, nb.  Block = hash of id modulo the corpus's block count
    (`blocks` (corpus, nb), else by rows)."""
    nb = blocks if blocks is not None else points.groupBy("corpus").agg(F.count(F.lit(1)).alias("_n")).select(
        "corpus", F.greatest(F.ceil(F.col("_n") / F.lit(block_rows)), F.lit(1)).cast("int").alias("nb"))
    return points.join(broadcast_if_small(nb), "corpus").withColumn(
        "blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))


def replicate(pts: DataFrame) -> DataFrame:
    """Each point to every block pair it takes part in: (bi, bj) = (min, max)(blk, x)."""
    x = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    r = pts.withColumn("_x", x)
    return r.withColumn("bi", F.least("blk", "_x")).withColumn("bj", F.greatest("blk", "_x")).drop("_x")


def run_pairs(points: DataFrame, kernel, schema: str, block_rows: int = BLOCK_ROWS, blocks: DataFrame | None = None) -> DataFrame:
    """Apply `kernel(A, B, same_block) -> pandas.DataFrame` to every block pair of every corpus."""
    rep = replicate(blocked(points, block_rows, blocks))
    schema = schema.replace("corpus long", f"corpus {points.schema['corpus'].dataType.simpleString()}")

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        a = pdf[pdf["blk"] == bi].reset_index(drop=True)
        b = a if bi == bj else pdf[pdf["blk"] == bj].reset_index(drop=True)
        out = kernel(a, b, bi == bj)
        if out is None or not len(out):
            return pd.DataFrame({f.split()[0]: [] for f in schema.split(",")}, dtype=object)
        out.insert(0, "corpus", pdf["corpus"].iloc[0])
        return out

    return rep.groupBy("corpus", "bi", "bj").applyInPandas(fn, schema)


# ------------------------------------------------------------------ metrics

def mat(df: pd.DataFrame, col: str = "vec") -> np.ndarray:
    if not len(df):
        return np.zeros((0, 1))
    return np.vstack(df[col].to_numpy()).astype(np.float64)


def cosine_sim(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    na = np.linalg.norm(A, axis=1)
    nb = np.linalg.norm(B, axis=1)
    na[na == 0] = 1.0
    nb[nb == 0] = 1.0
    return (A / na[:, None]) @ (B / nb[:, None]).T


def euclidean(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    d2 = (A * A).sum(1)[:, None] + (B * B).sum(1)[None, :] - 2.0 * (A @ B.T)
    return np.sqrt(np.maximum(d2, 0.0))


def minkowski(A: np.ndarray, B: np.ndarray, p: float) -> np.ndarray:
    out = np.empty((len(A), len(B)))
    for s in range(0, len(A), 16):  # bounds the differences held at once
        out[s:s + 16] = (np.abs(A[s:s + 16, None, :] - B[None, :, :]) ** p).sum(axis=2) ** (1.0 / p)
    return out


def metric_fn(metric: str):
    if metric == "cosine":  # distance 1 - cos
        return lambda A, B: 1.0 - cosine_sim(A, B)
    if metric == "euclidean":
        return euclidean
    if metric.startswith("minkowski"):
        p = float(metric.split(":")[1]) if ":" in metric else 1.5
        return lambda A, B: minkowski(A, B, p)
    raise ValueError(metric)


def _both_ways(a, b, same, D):
    """(ids_a, ids_b, D) plus the mirrored view for cross-block pairs; self pairs masked."""
    ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
    views = [(ia, ib, D)]
    if not same:
        views.append((ib, ia, D.T))
    return views


def _smallest(a, b, same, D, k: int, name: str) -> pd.DataFrame:
    """(id, nb_id, `name`): per row the k smallest finite entries of D, ties by the other id."""
    out = []
    for ia, ib, M in _both_ways(a, b, same, D):
        M = M.copy()
        if same:
            np.fill_diagonal(M, np.inf)
        by_id = np.argsort(ib, kind="stable")
        M = M[:, by_id]
        take = min(k, M.shape[1])
        edge = np.partition(M, take - 1, axis=1)[:, take - 1]  # the k-th smallest, no row is sorted whole (nan is last)
        i, j = np.nonzero(np.isfinite(M) & ~(M > edge[:, None]))  # more than k where they tie; in order of the id
        order = np.lexsort((j, M[i, j], i))
        i, j = i[order], j[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k  # i rises
        i, j = i[first], j[first]
        out.append(pd.DataFrame({"id": ia[i], "nb_id": ib[by_id][j], name: M[i, j]}))
    return pd.concat(out)


# ------------------------------------------------------------------ operators

def knn(points: DataFrame, k: int = 5, metric: str = "minkowski:1.5") -> DataFrame:
    """JN12: (corpus, id, nb_id, d, rank) the k nearest other points (ties by nb_id), over pivot cells."""
    from loomtext.operators import cells

    return cells.knn(points, k, metric)


def _beside(points: DataFrame, table: DataFrame):
    """(rows, get): get(corpus, part) is the row of `table` (one a corpus) for a part of `rows`; the table is sent
    to the tasks once, or joined to the points where it is too large for that."""
    shared = share_if_small(table)
    if shared is not None:
        return points, lambda corpus, part: shared.value[corpus][0]
    return points.join(broadcast_if_small(table), "corpus"), lambda corpus, part: part.iloc[0]


def row_stats(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """AG11: cosine similarity mean and population std of each row without its diagonal.

    No pair is formed: with unit rows x, sum_j s_ij = x_i . sum_j x_j and sum_j (s_ij - m)^2 follows
    from the second moment matrix of the corpus about its mean direction.  With c = mean of the rows and
    s_ij = x_i . c + x_i . (x_j - c), the variance of a row is x_i' C x_i (C the covariance of the rows)
    up to the diagonal term, which is taken out; this form does not cancel for rows that are nearly
    equal.  Per corpus the tasks send d sums and d x d products (partial sums, no group in one task)."""
    cor = points.schema["corpus"].dataType.simpleString()
    pts = points.select("corpus", "id", F.col("vec").cast("array<double>").alias("vec"))

    def unit(pdf: pd.DataFrame) -> np.ndarray:
        X = np.vstack(pdf["vec"].to_numpy()).astype(float)
        n = np.linalg.norm(X, axis=1, keepdims=True)
        return X / np.where(n == 0, 1.0, n)

    def sums(it):
        total: dict = {}
        for pdf in it:
            for corpus, part in pdf.groupby("corpus", sort=False):
                s = unit(part).sum(0)
                total[corpus] = (total[corpus][0] + len(part), total[corpus][1] + s) if corpus in total else (len(part), s)
        if total:
            yield pd.DataFrame({"corpus": list(total), "n": [n for n, _ in total.values()], "s": [list(s) for _, s in total.values()]})

    first = pts.mapInPandas(sums, f"corpus {cor}, n long, s array<double>")
    per = first.select("corpus", "n", F.posexplode("s").alias("i", "x")).groupBy("corpus", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    mean = cut_lineage(per.groupBy("corpus").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).select(
        "corpus", "n", F.transform("s", lambda e: e["x"] / F.col("n")).alias("c")))
    centred, mean_of = _beside(pts, mean)

    def products(it):
        total: dict = {}
        for pdf in it:
            for corpus, part in pdf.groupby("corpus", sort=False):
                Y = unit(part) - np.asarray(mean_of(corpus, part)["c"])
                total[corpus] = total.get(corpus, 0) + Y.T @ Y
        for corpus, P in total.items():
            yield pd.DataFrame({"corpus": [corpus] * len(P), "i": np.arange(len(P)), "row": list(P)})

    second = centred.mapInPandas(products, f"corpus {cor}, i int, row array<double>")
    cells = second.select("corpus", "i", F.posexplode("row").alias("j", "x")).groupBy("corpus", "i", "j").agg(F.sum("x").alias("x"))
    matrix = cut_lineage(cells.groupBy("corpus").agg(F.sort_array(F.collect_list(F.struct("i", "j", "x"))).alias("p"))  # d x d
                         .select("corpus", F.transform("p", lambda e: e["x"]).alias("p")))

    def stats(it):
        for pdf in it:
            for corpus, part in pdf.groupby("corpus", sort=False):
                found = both_of(corpus, part)
                X, c, n = unit(part), np.asarray(found["c"]), int(found["n"])
                P = np.asarray(found["p"]).reshape(len(c), len(c))
                own = (X * X).sum(1)  # the diagonal: 1, or 0 for a zero row
                if n < 2:
                    yield pd.DataFrame({"corpus": corpus, "id": part["id"], "mean": np.nan, "std": np.nan})
                    continue
                at = X @ c
                shift = (own - at) / (n - 1)  # mean of the others = at - shift
                ss = np.einsum("ni,ij,nj->n", X, P, X) - (own - at) ** 2  # of the others about at
                yield pd.DataFrame({"corpus": corpus, "id": part["id"], "mean": at - shift,
                                    "std": np.sqrt(np.maximum(ss / (n - 1) - shift ** 2, 0.0))})

    rows, both_of = _beside(pts, cut_lineage(mean.join(matrix, "corpus")))
    out = rows.mapInPandas(stats, f"corpus {cor}, id long, mean double, std double")
    return out.select("corpus", "id", F.when(~F.isnan("mean"), F.col("mean")).alias("mean"), F.when(~F.isnan("std"), F.col("std")).alias("std"))


def top_similar(points: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """SIM1 in bounded form: the k most cosine-similar other points per point."""
    from pyspark.sql import Window

    def kern(a, b, same):
        S = cosine_sim(mat(a), mat(b))
        out = _smallest(a, b, same, -S, k, "sim")
        out["sim"] = -out["sim"]
        return out

    cand = run_pairs(points, kern, "corpus long, id long, nb_id long, sim double", block_rows)
    w = Window.partitionBy("corpus", "id").orderBy(F.col("sim").desc(), "nb_id")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def within_radius(points: DataFrame, eps: float, metric: str = "cosine") -> DataFrame:
    """JN11: every ordered pair (id, nb_id), id != nb_id, with distance <= eps, over pivot cells."""
    from loomtext.operators import cells

    return cells.within_radius(points, eps, metric)


def silhouette_sums(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """SIL1 partial sums: points carry `labels ARRAY<INT>` (one label per candidate cut);
    returns (corpus, id, cut, label, dsum, cnt) = euclidean distance sums to other points."""
    def kern(a, b, same):
        D = euclidean(mat(a), mat(b))
        La, Lb = np.vstack(a["labels"].to_numpy()), np.vstack(b["labels"].to_numpy())
        out = []
        views = [(a["id"].to_numpy(), D, Lb)] + ([] if same else [(b["id"].to_numpy(), D.T, La)])
        for ids, M, Lother in views:
            M = M.copy()
            if same:
                np.fill_diagonal(M, np.nan)
            valid = ~np.isnan(M)
            M[~valid] = 0.0
            for cut in range(Lother.shape[1]):
                order = np.argsort(Lother[:, cut], kind="stable")  # the columns of a label side by side
                labs, at = np.unique(Lother[order, cut], return_index=True)
                sums = np.add.reduceat(M[:, order], at, axis=1)
                counts = np.add.reduceat(valid[:, order], at, axis=1, dtype=np.int64)
                out.append(pd.DataFrame({"id": np.repeat(ids, len(labs)), "cut": cut, "label": np.tile(labs, len(ids)),
                                         "dsum": sums.ravel(), "cnt": counts.ravel()}))
        return pd.concat(out)

    return run_pairs(points, kern, "corpus long, id long, cut int, label int, dsum double, cnt long", block_rows)


def silhouette(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """SIL1 (A-10): (corpus, cut, score) mean silhouette per candidate cut, euclidean."""
    s = silhouette_sums(points, block_rows).groupBy("corpus", "id", "cut", "label").agg(
        F.sum("dsum").alias("dsum"), F.sum("cnt").alias("cnt"))
    own = points.select("corpus", "id", F.posexplode("labels").alias("cut", "own"))
    j = s.join(own, ["corpus", "id", "cut"])
    per = j.groupBy("corpus", "id", "cut").agg(
        F.max(F.when(F.col("label") == F.col("own"), F.try_divide("dsum", "cnt"))).alias("a"),
        F.max(F.when(F.col("label") == F.col("own"), F.col("cnt"))).alias("own_others"),
        F.min(F.when(F.col("label") != F.col("own"), F.try_divide("dsum", "cnt"))).alias("b"))
    sil = F.when(F.coalesce(F.col("own_others"), F.lit(0)) == 0, F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.groupBy("corpus", "cut").agg(F.avg(F.coalesce(sil, F.lit(0.0))).alias("score"))


def silhouette_squared(points: DataFrame) -> DataFrame:
    """SIL1 by squared euclidean distances: (corpus, score) of points (corpus, id, vec, label), without pairs.

    With n, s and q the number, sum and sum of squares of a cluster's vectors, the mean squared distance of x
    from it is |x|^2 - 2 x.s/n + q/n; within its own cluster x itself takes no part (factor n / (n - 1)).  One
    aggregation gives the moments, one the score.  Vectors are taken about the mean of their corpus, so that
    distant clusters lose no digits.  A point alone in its cluster scores 0, a corpus of one cluster 0."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    kind = lambda cells, *key: cells.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).select(
        *key, F.transform("s", lambda e: e["x"]).alias("m"))
    vec = F.col("vec").cast("array<double>")
    entries = points.select("corpus", F.posexplode(vec).alias("i", "x"))
    centre = kind(entries.groupBy("corpus", "i").agg(F.avg("x").alias("x")), "corpus")
    pts = cut_lineage(points.join(broadcast_if_small(centre), "corpus").select(
        "corpus", "id", "label", F.zip_with(vec, F.col("m"), lambda x, m: x - m).alias("v")))
    sizes = pts.groupBy("corpus", "label").agg(F.count(F.lit(1)).alias("n"), F.avg(dot("v", "v")).alias("q"))
    cells = pts.select("corpus", "label", F.posexplode("v").alias("i", "x")).groupBy("corpus", "label", "i").agg(F.avg("x").alias("x"))
    moments = cut_lineage(sizes.join(kind(cells, "corpus", "label"), ["corpus", "label"]).withColumnRenamed("label", "other"))
    far = pts.join(broadcast_if_small(moments), "corpus")  # a row for each cluster of the corpus
    d = F.greatest(dot("v", "v") - 2 * dot("v", "m") + F.col("q"), F.lit(0.0))
    own = F.col("label") == F.col("other")
    per = far.groupBy("corpus", "id", "label").agg(
        F.max(F.when(own & (F.col("n") > 1), d * F.col("n") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, d)).alias("b"))
    score = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.groupBy("corpus").agg(F.avg(F.coalesce(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), score), F.lit(0.0))).alias("score"))
