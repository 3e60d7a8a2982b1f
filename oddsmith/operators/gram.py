"""Sums of products by group: what least squares needs of the rows, however many there are.

A fit over d columns needs n, the d sums and the d x d products.  These add up, so a task merges
its own rows first and one row a group reaches the solver; sums over parts (lags, days, windows)
can be added or taken apart afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def triangle(d: int) -> list[tuple[int, int]]:
    """The cells (i, j), i <= j, of a symmetric matrix in the order in which they are stored."""
    return [(i, j) for i in range(d) for j in range(i, d)]


def product_sums(columns: Sequence[Column], where: Column | None = None) -> list[Column]:
    """Aggregates for the upper triangle of sum(x x') over (1, columns), in the order of ``triangle``."""
    x = [F.lit(1.0), *columns]
    kept = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    return [F.coalesce(F.sum(kept(x[i] * x[j])), F.lit(0.0)) for i, j in triangle(len(x))]


def square(cells: np.ndarray) -> np.ndarray:
    """The symmetric matrix of a stored triangle."""
    d = int((np.sqrt(8 * len(cells) + 1) - 1) / 2)
    out = np.empty((d, d))
    for (i, j), v in zip(triangle(d), cells, strict=True):
        out[i, j] = out[j, i] = v
    return out


def unexplained(gram: np.ndarray, target: int, regressors: Sequence[int], least: float = 1e-10) -> float:
    """Sum of squares of the target that the regressors leave, from a gram matrix whose index 0 is the constant.

    Means are taken out first and columns scaled to length one; directions shorter than ``least`` of
    that are no direction of their own.
    """
    n = max(gram[0, 0], 1.0)
    pick = [target, *regressors]
    centred = gram[np.ix_(pick, pick)] - np.outer(gram[pick, 0], gram[pick, 0]) / n
    total = float(centred[0, 0])
    length = np.sqrt(np.maximum(np.diag(centred)[1:], 0))
    # a column that hardly moves beside its level is constant
    used = length > 1e-7 * np.sqrt(np.maximum(np.diag(gram)[list(regressors)], 0)) + 1e-12
    if not used.any():
        return total
    a = centred[1:, 1:][np.ix_(used, used)] / np.outer(length[used], length[used])
    b = centred[0, 1:][used] / length[used]
    values, vectors = np.linalg.eigh(a)
    along = vectors.T @ b
    own = values > least
    return max(total - float((along[own] ** 2 / values[own]).sum()), 0.0)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float)


def _add_up(df: DataFrame, part, shape: tuple[int, ...]) -> dict[int, np.ndarray]:
    """``part(batch)`` gives (group, array of ``shape``) of a batch; summed in each task, then by an aggregate over the cells.

    What reaches the driver is one array of ``shape`` a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for group, value in part(batch):
                    held[group] = held[group] + value if group in held else value
        for group, value in held.items():
            cells = value.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), group), pa.int64()), pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)], names=["grp", "cell", "value"])

    out: dict[int, np.ndarray] = {}
    for r in df.mapInArrow(run, "grp long, cell int, value double").groupBy("grp", "cell").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["grp"], np.zeros(int(np.prod(shape))))[r["cell"]] = r["value"]
    return {k: v.reshape(shape) for k, v in sorted(out.items())}


def moments(df: DataFrame, d: int, x: str = "x", block: str | None = None) -> dict[int, np.ndarray]:
    """sum of (1, x)(1, x)' of the rows of each block, ``x`` an array of d doubles; blocks are few (windows, not keys).

    Matrices of blocks add up: the sum over the first blocks is the matrix of all rows up to there.
    """
    rows = df.select(F.col(x).alias("x"), (F.col(block) if block else F.lit(0)).cast("long").alias("block"))

    def part(batch: pa.RecordBatch):
        values, blocks = _matrix(batch.column("x")), batch.column("block").to_numpy()
        values = np.column_stack([np.ones(len(values)), values])
        for b in np.unique(blocks):
            mine = values[blocks == b]
            yield int(b), mine.T @ mine

    return _add_up(rows, part, (d + 1, d + 1))


def covariance(gram: np.ndarray) -> np.ndarray:
    mean = gram[0, 1:] / gram[0, 0]
    return gram[1:, 1:] / gram[0, 0] - np.outer(mean, mean)


def correlation(gram: np.ndarray) -> np.ndarray:
    c = covariance(gram)
    s = np.sqrt(np.maximum(np.diag(c), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = c / np.outer(s, s)
    np.fill_diagonal(r, 1.0)
    return r


#: least change of a coefficient that asks for another step, and most steps
STILL, STEPS = 1e-9, 60


def logistic_fits(df: DataFrame, windows: Sequence[Sequence[int]], bases: Sequence[np.ndarray], x: str = "x", label: str = "y", block: str = "block") -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(coefficients, information matrix) of one logistic regression a window, all by the same passes.

    A window learns from the rows of its blocks, projected on its basis (d x k).  A step of
    reweighted least squares is one pass: every task adds up the weighted products and the gradient of
    all windows.  A step that would lower the likelihood is halved.
    """
    rows = df.select(F.col(x).alias("x"), F.col(label).cast("double").alias("y"), F.col(block).cast("long").alias("block"))
    k = bases[0].shape[1] + 1
    beta, step = [np.zeros(k) for _ in windows], [np.zeros(k) for _ in windows]
    best: list[float] = [-np.inf] * len(windows)
    information = [np.eye(k) for _ in windows]
    moving = set(range(len(windows)))
    for _ in range(STEPS):
        trial = [b + s for b, s in zip(beta, step, strict=True)]

        def part(batch: pa.RecordBatch, trial=trial, moving=frozenset(moving)):
            values, y, blocks = _matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("block").to_numpy()
            for w in sorted(moving):
                mine = np.isin(blocks, windows[w])
                if not mine.any():
                    continue
                z = np.column_stack([np.ones(int(mine.sum())), values[mine] @ bases[w]])
                eta = z @ trial[w]
                p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                likelihood = float((y[mine] * eta - np.logaddexp(0, eta)).sum())
                # information, gradient and likelihood as one square
                out = np.zeros((k + 1, k + 1))
                out[:k, :k] = (z * (p * (1 - p))[:, None]).T @ z
                out[:k, k] = z.T @ (y[mine] - p)
                out[k, k] = likelihood
                yield w, out

        sums = _add_up(rows, part, (k + 1, k + 1))
        for w in sorted(moving):
            if w not in sums:
                moving.discard(w)
                continue
            likelihood = sums[w][k, k]
            if likelihood < best[w] - 1e-9 * abs(best[w]):
                step[w] = step[w] / 2
            else:
                beta[w], best[w], information[w] = trial[w], likelihood, sums[w][:k, :k]
                step[w] = np.linalg.pinv(information[w] + 1e-10 * np.eye(k)) @ sums[w][:k, k]
            if np.abs(step[w]).max() < STILL or np.abs(beta[w]).max() > 1e4:
                moving.discard(w)
        if not moving:
            break
    return beta, information


def logistic_hits(df: DataFrame, tests: dict[int, int], beta: Sequence[np.ndarray], bases: Sequence[np.ndarray], x: str = "x", label: str = "y", block: str = "block") -> dict[int, tuple[int, float]]:
    """(rows, share predicted right) of each window on its test block; ``tests``: block by window."""
    rows = df.select(F.col(x).alias("x"), F.col(label).cast("double").alias("y"), F.col(block).cast("long").alias("block"))

    def part(batch: pa.RecordBatch):
        values, y, blocks = _matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("block").to_numpy()
        for w, b in tests.items():
            mine = blocks == b
            if mine.any():
                z = beta[w][0] + values[mine] @ bases[w] @ beta[w][1:]
                yield w, np.array([float(mine.sum()), float(((z > 0) == (y[mine] == 1)).sum())])

    return {w: (int(v[0]), float(v[1] / v[0])) for w, v in _add_up(rows, part, (2,)).items()}
