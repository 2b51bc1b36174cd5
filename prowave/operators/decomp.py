"""Low-rank bases of a feature matrix, over all rows: what a round needs are sums of products of features.

Principal component pursuit splits M into a low-rank and a sparse part by the
alternating directions of Candes, Li, Ma and Wright (J. ACM 58, 2011, algorithm
1): a fixed penalty mu = n1 n2 / (4 |M|_1), the weight 1 / sqrt(max(n1, n2)), all
parts 0 at the start. Singular values are thresholded through the F x F matrix
of products, X V diag(max(0, 1 - t / s)) V', which works row by row once the
products are summed up. Weights on given bases are least absolute deviations by
reweighted least squares, whose normal matrices are sums over rows as well.

So tables stay distributed: F x F numbers a task come to the driver, rows never.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prowave.session import cut_lineage

from .splits import sample_nodes

TOLERANCE = 1e-3
ROUNDS = 15
LEAST_RESIDUAL = 1e-6


def shrink(x: np.ndarray, tol: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - tol, 0)


def randomized_svd(a: np.ndarray, rank: int, oversample: int = 0, rounds: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(U, s, V) of about the ``rank`` largest singular values: a random range, kept orthonormal between power iterations."""
    rank = min(rank, *a.shape)
    size = min(rank + oversample, *a.shape)
    q = np.random.default_rng(seed).standard_normal((a.shape[1], size))
    for _ in range(rounds):
        q, _ = np.linalg.qr(a @ q)
        q, _ = np.linalg.qr(a.T @ q)
    q, _ = np.linalg.qr(a @ q)
    u, s, vt = np.linalg.svd(q.T @ a, full_matrices=False)
    return (q @ u)[:, :rank], s[:rank], vt[:rank].T


def pseudo_inverse(a: np.ndarray, rank: int, least: float = 1e-6) -> np.ndarray:
    u, s, v = randomized_svd(a, rank, rounds=max(1, int(rank**0.5)))
    return (v * np.where(s > least, 1 / np.maximum(s, least), 0)) @ u.T


def threshold_map(products: np.ndarray, by: float) -> np.ndarray:
    """P such that X P has X's singular values less ``by``, from X'X."""
    square, v = np.linalg.eigh(products)
    s = np.sqrt(np.maximum(square, 0))
    return (v * np.where(s > by, 1 - by / np.maximum(s, 1e-300), 0)) @ v.T


def pursue(m: np.ndarray, sparse: np.ndarray, dual: np.ndarray, p: np.ndarray, mu: float, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, sparse, dual) of some rows after a round."""
    low = (m - sparse + dual / mu) @ p
    sparse = shrink(m - low + dual / mu, weight / mu)
    return low, sparse, dual + mu * (m - low - sparse)


def robust_pca(m: np.ndarray, sparsity: float = 1.0, rounds: int = 100, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(low, sparse) parts of a matrix in memory, until what is left is ``tolerance`` of it."""
    sparse, dual, low = np.zeros_like(m), np.zeros_like(m), np.zeros_like(m)
    mu, weight = m.size / max(4 * np.abs(m).sum(), 1e-300), sparsity / max(*m.shape, 1) ** 0.5
    for _ in range(rounds):
        x = m - sparse + dual / mu
        low, sparse, dual = pursue(m, sparse, dual, threshold_map(x.T @ x, 1 / mu), mu, weight)
        if np.linalg.norm(m - low - sparse) <= tolerance * np.linalg.norm(m):
            break
    return low, sparse


def _stack(col: pa.Array) -> np.ndarray:
    return np.stack(col.to_numpy(zero_copy_only=False))


def summed(df: DataFrame, columns: list[str], of: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum of ``of`` over all row blocks of the named array columns; flat, empty for an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                now = of(*[_stack(b.column(c)) for c in columns]).reshape(-1)
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total)], names=["at", "p"])

    return df.select(*columns).mapInArrow(run, "at long, p double").groupBy("at").agg(F.sum("p").alias("p")).orderBy("at").toPandas()["p"].to_numpy()


def _doubles(wide: DataFrame, name: str = "m") -> DataFrame:
    return wide.select("id", F.col("embedding").cast("array<double>").alias(name))


def products(wide: DataFrame) -> np.ndarray:
    """X'X of (id, embedding), summed over all rows by blocks."""
    got = summed(_doubles(wide), ["m"], lambda x: x.T @ x)
    size = int(round(len(got) ** 0.5))
    return got.reshape(size, size)


def singular_values(wide: DataFrame, rank: int) -> np.ndarray:
    """The ``rank`` largest singular values of all rows, from the features' products; exact but for those below about 1e-8 of the largest."""
    got = products(wide)
    return np.sqrt(np.maximum(np.linalg.eigvalsh(got)[::-1][:rank], 0)) if got.size else np.zeros(0)


def sparse_norms(wide: DataFrame, sparsity: float = 1.0, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The norm of each feature's sparse part, by pursuit over all rows; the rows' state is written each round."""
    rows = _doubles(wide)
    sizes = summed(rows, ["m"], lambda m: np.array([float(len(m)), np.abs(m).sum(), (m**2).sum(), float(m.shape[1])]))
    if not len(sizes):
        return np.zeros(0)
    n, total, square = sizes[:3]
    width = len(rows.first()["m"])
    mu, weight = n * width / max(4 * total, 1e-300), sparsity / max(n, width) ** 0.5
    zero = F.array_repeat(F.lit(0.0), width)
    state = rows.select("m", zero.alias("sparse"), zero.alias("dual"), F.array(F.lit(0.0)).alias("left"))
    for k in range(rounds):
        got = summed(state, ["m", "sparse", "dual", "left"], lambda m, s, y, left: np.append((x := m - s + y / mu).T @ x, (left**2).sum()))
        if k and got[-1] <= tolerance**2 * square:
            break
        p = threshold_map(got[:-1].reshape(width, width), 1 / mu)

        def step(batches: Iterator[pa.RecordBatch], p: np.ndarray = p) -> Iterator[pa.RecordBatch]:
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1)))
            for b in batches:
                if b.num_rows:
                    m = _stack(b.column("m"))
                    low, sparse, dual = pursue(m, _stack(b.column("sparse")), _stack(b.column("dual")), p, mu, weight)
                    left = np.linalg.norm(m - low - sparse, axis=1, keepdims=True)
                    yield pa.RecordBatch.from_arrays([b.column("m"), *map(lists, (sparse, dual, left))], names=["m", "sparse", "dual", "left"])

        state = cut_lineage(state.mapInArrow(step, state.schema))
    return np.sqrt(summed(state, ["sparse"], lambda s: (s**2).sum(0)))


def deviation_weights(wide: DataFrame, bases: list[int], rounds: int = 10) -> np.ndarray:
    """(bases, features): each feature's weights on the base features by least absolute deviations, over all rows."""
    rows = _doubles(wide)
    theta: np.ndarray | None = None
    for _ in range(rounds):

        def normal(m: np.ndarray, theta: np.ndarray | None = theta) -> np.ndarray:
            b = m[:, bases]
            w = np.ones_like(m) if theta is None else 1 / np.maximum(np.abs(m - b @ theta), LEAST_RESIDUAL)
            return np.concatenate([np.einsum("nf,nj,nk->fjk", w, b, b).reshape(m.shape[1], -1), (w * m).T @ b], axis=1)

        got = summed(rows, ["m"], normal).reshape(-1, len(bases) ** 2 + len(bases))
        left = got[:, : len(bases) ** 2].reshape(-1, len(bases), len(bases))
        theta = np.stack([np.linalg.lstsq(a, c, rcond=1e-12)[0] for a, c in zip(left, got[:, len(bases) ** 2 :], strict=True)], axis=1)
    return theta


def principal_bases(wide: DataFrame, count: int, sparsity: float = 1.0, share: float = 1.0, seed: int = 0) -> tuple[list[int], DataFrame]:
    """(features chosen as bases, (feat, base, theta)): those whose sparse part is smallest, the largest of them first.

    All rows count; with a ``share`` under 1 that share of the nodes, at every size.
    """
    if share < 1:
        wide = cut_lineage(wide.join(sample_nodes(wide, max(1, int(wide.count() * share)), seed), "id"))
    norms = sparse_norms(wide, sparsity)
    least = [int(f) for f in np.lexsort((np.arange(len(norms)), norms))[:count][::-1]]
    theta = deviation_weights(wide, least)
    rows = [(f, b, float(theta[k, f])) for k, b in enumerate(least) for f in range(len(norms)) if f not in least]
    return least, wide.sparkSession.createDataFrame(rows, "feat int, base int, theta double")
