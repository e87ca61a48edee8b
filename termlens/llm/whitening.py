"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the factor.

Entries become integers ``floor(SCALE * c)``, and the fit list is each different
integer vector once, so copies don't weigh.  Spark sums the counts, the exact
sums and the centred products of the list; only ``dim`` x ``dim`` numbers reach
the driver.  There the covariance is factorised with pivoting (``P' V P = L
L'``; a rank below the dimension ends it early), and one-sided Jacobi rotations
make the columns of ``L`` orthogonal: their squared norms are the eigenvalues,
the columns scaled to length 1 (rows put back in place) the components.
Rotating the factor instead of the product keeps small eigenvalues accurate.

Defined results: rows whose vector is null or holds a null, a non-finite entry
or one whose integer doesn't fit a long are left out, as are those whose length
isn't the most frequent one of the fit list (ties: the shorter).  Equal vectors
get equal results, repeated ids stay separate rows.  Directions without variance
(eigenvalue below ``dim * RELATIVE_ZERO`` of the largest) are no components: an
empty table, a single vector or vectors of length 0 have none.  A ``deviation``
that doesn't fit a long is null.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import cut_lineage, free_name

SCALE = 256
COMPONENTS = 4
RELATIVE_ZERO = 1e-13
MAX_SWEEPS = 60
BLOCK_ROWS = 4096          # rows centred at once
LONG = float(1 << 63)


def integers(vector: str, scale: int = SCALE) -> Column:
    """The vector as ``array<bigint>``, null where the row is to be left out."""
    v = "`" + vector.replace("`", "``") + "`"
    return F.expr(
        f"CASE WHEN forall({v}, c -> c IS NOT NULL AND NOT isnan(c) AND abs({scale} * double(c)) < {LONG}D)"
        f" THEN transform({v}, c -> bigint(floor({scale} * double(c)))) END")


@dataclasses.dataclass(frozen=True)
class WhiteningModel:
    n: int                     # vectors of the fit list
    sums: list[int]            # exact, per dimension
    eigenvalues: np.ndarray    # [components], falling
    basis: np.ndarray          # [dim, components], unit columns
    trace: float               # of the covariance
    identity_error: float      # of the whitened fit list's covariance
    scale: int = SCALE

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.basis / np.sqrt(self.eigenvalues))

    def deviation(self, x: np.ndarray) -> list:
        """Sum over dimensions of ``(n * x - sums) ** 2``, exact; null beyond a long."""
        largest = self.n * float(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if largest ** 2 * max(self.dim, 1) < LONG / 2:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = (sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x)
        return [v if v < 1 << 63 else None for v in exact]


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> WhiteningModel:
    """The model of ``df``'s fit list."""
    x = df.select(integers(vector, scale).alias("x")).where("x IS NOT NULL").distinct()
    x = cut_lineage(x)
    common = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return WhiteningModel(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, scale)
    n, dim = int(common["count"]), int(common["d"])
    x = x.where(F.size("x") == dim)

    def totals(batches):
        total = None
        for b in batches:
            m = _matrix(b, dim)
            safe = float(np.abs(m).max(initial=0)) * len(m) < LONG / 2
            part = m.sum(0).tolist() if safe else [sum(map(int, col)) for col in m.T]
            total = part if total is None else [s + t for s, t in zip(total, part, strict=True)]
        if total:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim), pa.int32()), "s": [str(s) for s in total]})

    sums = {r.i: int(r.s) for r in x.mapInArrow(totals, "i int, s string").groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    sums = [sums[i] for i in range(dim)]
    mean = np.array([s / n for s in sums])
    upper = np.triu_indices(dim)

    def products(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b, dim)
            for lo in range(0, len(m), BLOCK_ROWS):
                c = m[lo:lo + BLOCK_ROWS] - mean
                total += c.T @ c
        yield pa.RecordBatch.from_pydict({"i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), "v": total[upper]})

    cov = np.zeros((dim, dim))
    for r in x.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        cov[r.i, r.j] = cov[r.j, r.i] = r.v / n
    values, vectors = eigen(cov)
    model = WhiteningModel(n, sums, values[:components], vectors[:, :components], float(np.trace(cov)), 0.0, scale)
    return dataclasses.replace(model, identity_error=_identity_error(x, model))


def _identity_error(x: DataFrame, model: WhiteningModel) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k, dim = len(model.eigenvalues), model.dim
    if not k:
        return 0.0

    def products(batches):
        total = np.zeros((k + 1, k + 1))       # the last column holds the sums
        for b in batches:
            m = _matrix(b, dim)
            for lo in range(0, len(m), BLOCK_ROWS):
                w = model.whitened(m[lo:lo + BLOCK_ROWS])
                w = np.column_stack((w, np.ones(len(w))))
                total += w.T @ w
        i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "v": total.ravel()})

    total = np.zeros((k + 1, k + 1))
    for r in x.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v / model.n
    means = total[:k, k]
    return float(np.abs(total[:k, :k] - np.outer(means, means) - np.eye(k)).max())


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(L, order)``: lower triangular L [dim, rank] with ``a[order][:, order] = L L'``."""
    a, dim = a.copy(), len(a)
    order, factor = np.arange(dim), np.zeros((dim, dim))
    rest = np.diag(a).copy()                   # what the columns so far don't explain
    least = dim * np.finfo(float).eps * rest.max(initial=0.0)
    for k in range(dim):
        p = k + int(np.argmax(rest[k:]))
        if rest[p] <= least:
            return factor[:, :k], order
        if p != k:
            a[[k, p]], factor[[k, p]] = a[[p, k]], factor[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
            order[[k, p]], rest[[k, p]] = order[[p, k]], rest[[p, k]]
        factor[k, k] = np.sqrt(rest[k])
        factor[k + 1:, k] = (a[k + 1:, k] - factor[k + 1:, :k] @ factor[k, :k]) / factor[k, k]
        rest[k + 1:] -= factor[k + 1:, k] ** 2
    return factor, order


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of disjoint pairs (round robin)."""
    seats = list(range(n + n % 2))
    out = []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(min(p), max(p)) for p in zip(seats[:half], seats[:half - 1:-1], strict=True) if max(p) < n]
        out.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """``factor`` rotated by columns until they are orthogonal (disjoint pairs at once)."""
    g = factor.copy()
    rounds, done = _rounds(g.shape[1]) if g.shape[1] > 1 else [], 4 * np.finfo(float).eps
    for _ in range(MAX_SWEEPS):
        worst = 0.0
        for p, q in rounds:
            gp, gq = g[:, p], g[:, q]
            a, b, c = (gp * gp).sum(0), (gq * gq).sum(0), (gp * gq).sum(0)
            off = np.abs(c) / np.maximum(np.sqrt(a * b), np.finfo(float).tiny)
            worst = max(worst, float(off.max(initial=0.0)))
            turn = off > done
            zeta = (b - a) / np.where(turn, 2 * c, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, t)
            cos, sin = np.where(turn, cos, 1.0), np.where(turn, cos * t, 0.0)
            g[:, p], g[:, q] = cos * gp - sin * gq, sin * gp + cos * gq
        if worst <= done:
            break
    return g


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling, positive ones only) and unit eigenvectors of a covariance."""
    factor, order = pivoted_cholesky(cov)
    g = one_sided_jacobi(factor)
    norms = np.sqrt((g * g).sum(0))
    rank = np.argsort(-norms, kind="stable")
    values = norms[rank] ** 2
    rank = rank[values > len(cov) * RELATIVE_ZERO * values.max(initial=0.0)]
    vectors = np.zeros((len(cov), len(rank)))
    vectors[order] = g[:, rank] / norms[rank]
    return norms[rank] ** 2, vectors


def add_whitened(df: DataFrame, model: WhiteningModel, vector: str = "embedding", out: str = "white") -> DataFrame:
    """The rows that the model takes, with the struct column ``out`` (``deviation``,
    ``whitened``: one double a component); a column of that name is replaced."""
    dim = model.dim

    @F.pandas_udf("deviation long, whitened array<double>")
    def white(x: pd.Series) -> pd.DataFrame:
        m = np.stack(x.to_numpy()).astype(np.int64) if len(x) else np.zeros((0, dim), np.int64)
        return pd.DataFrame({"deviation": pd.array(model.deviation(m), "Int64"), "whitened": list(model.whitened(m))})

    x = free_name(df, "x")
    rows = df.withColumn(x, integers(vector, model.scale)).where(F.size(x) == (dim if len(model.eigenvalues) else -2))
    return rows.withColumn(out, white(x)).drop(x)
