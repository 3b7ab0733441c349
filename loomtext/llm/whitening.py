"""Embedding whitening by QDWH spectral divide and conquer.

Entries c become the integers x = floor(64 c) + 1000000, so sums over all rows are exact.  Two passes
over the vectors give the per-dimension sums and the covariance (centred before multiplying); both are
summed in the tasks and by Spark, and only matrices of the vectors' dimension reach the driver, however
many rows there are.

The covariance is split there: the polar factor of the shifted matrix, found by dynamically weighted
Halley steps (QR while the weights are large, Cholesky after), has the eigenvalues +1 and -1 on the two
sides of the shift, so (factor + 1) / 2 projects on the invariant subspace above it.  Each side is
compressed on its subspace and split again until it is of size one, or a multiple of the identity, where
any basis will do.  Mean, components and scales then go to all tasks by broadcast.

Rows are dropped whose vector is null, empty or holds null or non-finite entries (or entries beyond 2^40,
which cannot be summed as integers).  Vectors must agree in length: the commonest length among the rest
is taken, the larger of equally common ones, and rows of another length are dropped too.  Components with
an eigenvalue of zero (up to rounding) cannot be scaled and are left out, so a table of equal vectors
gives no rows.  Repeated rows count and come back row by row; a null vec_id is kept.  A deviation that
does not fit in a long is null.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import common as C

SCALE, SHIFT, LARGEST = 64.0, 1_000_000, float(1 << 40)
#: Rows handled at once inside a task.
ROWS = 4096


# ------------------------------------------------------------------ spectral divide and conquer
def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH.  Its eigenvalues are those of `a` taken
    to -1 and 1; directions in which `a` vanishes converge to neither."""
    d, eps = len(a), np.finfo(float).eps
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)  # the Frobenius norm bounds the largest
    low, one = eps, np.eye(d)
    for _ in range(60):
        last = x
        r = (4 * (1 - low**2) / low**4) ** (1 / 3)
        wa = np.sqrt(1 + r) + 0.5 * np.sqrt(8 - 4 * r + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + r)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:d] @ q[d:].T)
        else:
            half = np.linalg.cholesky(one + wc * x.T @ x)
            x = wb / wc * x + (wa - wb / wc) * np.linalg.solve(half.T, np.linalg.solve(half, x.T)).T
        x = (x + x.T) / 2
        low = min(low * (wa + wb * low**2) / (1 + wc * low**2), 1.0)
        if low > 1 - 10 * eps and np.linalg.norm(x - last) <= eps ** (1 / 3):
            break
    return x


def _shifts(a: np.ndarray, spread: float) -> Iterator[float]:
    """Shifts inside the spectrum: the diagonal's median, then places about its mean, which lies
    strictly between the smallest and the largest eigenvalue."""
    diagonal = np.diag(a)
    mean = diagonal.mean()
    yield float(np.median(diagonal))
    yield float(mean)
    for k in range(1, 40):
        yield float(mean + (-1) ** k * spread * 0.37 * k / 40 / np.sqrt(len(a)))


def _split(a: np.ndarray, spread: float, floor: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if no shift parts them
    with an error below `floor`."""
    d, best = len(a), None
    rng = np.random.default_rng(d)
    for sigma in _shifts(a, spread):
        p = (polar_factor(a - sigma * np.eye(d)) + np.eye(d)) / 2
        k = int(round(np.trace(p)))
        if not 0 < k < d:
            continue
        basis = rng.standard_normal((d, k))
        for _ in range(3):  # subspace iteration with the projector
            basis = np.linalg.qr(p @ basis)[0]
        q = np.linalg.qr(basis, mode="complete")[0]
        error = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or error < best[0]:
            best = error, q[:, :k], q[:, k:]
        if error <= floor:
            break
    return best[1:] if best else None


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors in columns) of a symmetric matrix."""
    d, norm, eps = len(v), np.linalg.norm(v), np.finfo(float).eps
    done: list[tuple[float, np.ndarray]] = []
    todo = [(v, np.eye(d))]
    while todo:
        a, basis = todo.pop()
        a = (a + a.T) / 2
        spread = np.linalg.norm(a - np.diag(a).mean() * np.eye(len(a)))
        halves = _split(a, spread, 4 * eps * norm) if len(a) > 1 and spread > 4 * eps * norm else None
        if halves is None:
            done += [(float(x @ v @ x), x) for x in basis.T]
        else:
            todo += [(q.T @ a @ q, basis @ q) for q in halves]
    done.sort(key=lambda x: -x[0])
    return np.array([e for e, _ in done]), np.stack([x for _, x in done], 1) if done else np.zeros((0, 0))


# ------------------------------------------------------------------ passes over the rows
def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(vec_id, integer vectors) of the remaining rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            vectors = C.column(part, "v")
            part = part.filter(pc.fill_null(pc.equal(pc.list_value_length(vectors), d), False))
            flat = C.column(part, "v").flatten()
            c = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, d)
            good = (np.abs(c) <= LARGEST).all(1)  # false for nan
            if good.any():
                yield C.column(part, "vec_id").filter(pa.array(good)), np.floor(SCALE * c[good]).astype(np.int64) + SHIFT


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1, np.int64)
        for _, x in _matrices(batches, d):
            total[0] += len(x)
            total[1:] += x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1), pa.int32()), pa.array(total)], names=["i", "s"])
    return run


def _products(n: int, s: np.ndarray, to: np.ndarray):
    """Sums of w w' over the rows, w the centred vector times `to`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((to.shape[1], to.shape[1]))
        for _, x in _matrices(batches, len(s)):
            w = (n * x - s) / n @ to
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])
    return run


def _covariance(rows: DataFrame, n: int, s: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The centres are exact, sums of n x - S over all rows being zero, so means of w need no pass of their own."""
    got = (rows.mapInArrow(_products(n, s, to), "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
           .groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow())
    out = np.zeros((to.shape[1], to.shape[1]))
    out[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
    return (out + out.T) / 2 / n


def _whiten(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, to = sent.value
        for ids, x in _matrices(batches, len(s)):
            far = n * x - s
            fits = (far.astype(float) ** 2).sum(1) < 2.0**63 - 2.0**20
            deviation = pa.array((far * far).sum(1), pa.int64(), mask=~fits)
            yield pa.RecordBatch.from_arrays([ids, deviation, pa.array(list(far / n @ to), pa.list_(pa.float64()))],
                                             names=["vec_id", "deviation", "whitened"])
    return run


COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> DataFrame:
    """One row per remaining vector and component, up to `most`, with the columns of COLUMNS."""
    spark = table.sparkSession
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    # null entries and nan compare as null and false
    usable = F.coalesce(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= LARGEST), F.lit(False))), F.lit(False)) & (F.size("v") > 0)
    common = rows.where(usable).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], COLUMNS)
    d = common["d"]
    sums = rows.mapInArrow(_sums(d), "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toArrow()["s"].to_numpy()
    n, s = int(sums[0]), sums[1:]
    v = _covariance(rows, n, s, np.eye(d))
    e, directions = components(v)
    count = int((e > d * np.finfo(float).eps * max(e[0], 0.0)).sum()) if e[0] > 0 else 0
    count = min(count, most)
    if not count:
        return spark.createDataFrame([], COLUMNS)
    to = directions[:, :count] / np.sqrt(e[:count])
    error = float(np.abs(_covariance(rows, n, s, to) - np.eye(count)).max())
    share = F.array(*(F.lit(float(x)) for x in e[:count] / np.trace(v)))
    sent = spark.sparkContext.broadcast((n, s, to))
    out = rows.mapInArrow(_whiten(sent), "vec_id long, deviation long, whitened array<double>")
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
