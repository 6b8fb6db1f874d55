"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation with full reorthogonalisation.

The centred rows X (divided by the root of their number) are never held together. Each step sends one direction z to the
executors, which form Xz and then Xᵀ(Xz) block by block; only their sums, one number a dimension, come back. A left
vector is never stored, as it would be as long as the table: u = Xw is known by w, so its products with other left
vectors are products of w and Xᵀu, both as short as a row. The driver keeps both bases orthogonal (every new vector
against all earlier ones, twice) and ends with a small bidiagonal matrix. Its singular values are deviations along the
components; its right singular vectors, turned by the right basis, are the components.

The steps stop at the number of dimensions, or earlier when the wanted components have converged and the variance not
yet seen is below the least of them, so no direction can be missed. A step whose remainder vanishes starts again from a
fresh direction; equal and zero deviations are found that way too.

Defined results. Rows with a null vector, or a null or non-finite entry, are left out, as are those whose length is not
the commonest one (of equally common lengths the largest). Entries beyond ±1e12 count as ±1e12. Directions without
variance (below 1e-12 of the largest) give no component, so an empty table or one of equal vectors gives no rows.
Repeated rows, ties and null ids are rows like any other. A deviation that exceeds a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

COMPONENTS = 32
SCALE, OFFSET, LIMIT = 64, 1_000_000, 1e12
_NOTHING = 1e-10  # a remainder of this share of the largest deviation is none
_FLAT = 1e-12  # least variance of a component, as a share of the largest
_ROWS = 1024  # rows of one block


def fit_list(df: DataFrame, vector: str, ident: str) -> DataFrame:
    """``ident`` and ``x``, the scaled whole numbers, of the rows that count."""
    c = F.col(vector)
    finite = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = lambda v: F.greatest(F.least(F.floor(v.cast("double") * SCALE), F.lit(int(LIMIT))), F.lit(-int(LIMIT)))
    rows = df.where(F.coalesce(finite, F.lit(False)))
    return rows.select(F.col(ident).alias("id"), F.transform(c, lambda v: (scaled(v) + OFFSET).cast("bigint")).alias("x"))


def _blocks(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            yield part, part.column(part.schema.get_field_index("x")).flatten().to_numpy().reshape(-1, dims)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S in whole numbers; Python's own where 64 bits might not hold them."""
    if n * (int(np.abs(x).max(initial=0)) + LIMIT) < 2.0**62 and float(np.abs(sums.astype(float)).max(initial=0)) < 2.0**62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _summed(rows: DataFrame, partial: Callable[[Iterable[np.ndarray], np.ndarray | None], np.ndarray], dims: int) -> np.ndarray:
    """The sum over all rows of what ``partial`` makes of the blocks of a partition; its size must not depend on the rows."""

    def run(batches):
        total = None
        for _, x in _blocks(batches, dims):
            part = partial(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total), dtype=np.int32), "v": total})

    parts = rows.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(parts))
    for r in parts:
        out[r["i"]] = r["v"]
    return out


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    if basis:
        q = np.array(basis)
        for _ in range(2):
            v = v - q.T @ (q @ v)
    return v


def bidiagonalise(product: Callable[[np.ndarray], tuple[float, np.ndarray]], dims: int, trace: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Deviations, falling, and components as rows. ``product(z)`` gives |Xz|² and XᵀXz; ``trace`` is |X|²."""
    random = np.random.default_rng(20)
    largest = np.sqrt(trace)
    right: list[np.ndarray] = []
    ws: list[np.ndarray] = []
    ys: list[np.ndarray] = []
    alphas, betas = [], []
    v, beta = random.standard_normal(dims), 0.0
    v /= np.linalg.norm(v)
    while True:
        right.append(v)
        z = v - beta * ws[-1] if ws else v
        square, y = product(z)
        for _ in range(2):  # against all earlier left vectors
            if ws:
                c = np.array(ws) @ y
                z, y, square = z - np.array(ws).T @ c, y - np.array(ys).T @ c, square - c @ c
        alpha = np.sqrt(max(square, 0.0))
        if alpha <= _NOTHING * largest:
            alpha, w, y = 0.0, np.zeros(dims), np.zeros(dims)
        else:
            w, y = z / alpha, y / alpha
        ws.append(w), ys.append(y), alphas.append(alpha)
        rest = _orthogonal(y - alpha * v, right)
        beta = float(np.linalg.norm(rest))
        k = len(right)
        _, sigma, turn = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        if k == dims:
            return sigma, turn @ np.array(right)
        fresh_start = beta <= _NOTHING * largest
        if k >= wanted:
            left = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))[0]
            unseen = trace - float(np.square(sigma).sum()) - (0.0 if fresh_start else beta**2)
            open_ends = np.abs(left[-1, :wanted]) * (0.0 if fresh_start else beta)
            if open_ends.max() <= 1e-15 * largest and unseen + beta**2 < 0.999 * sigma[wanted - 1] ** 2:
                return sigma, turn @ np.array(right)
        if fresh_start:
            rest, beta = _orthogonal(random.standard_normal(dims), right), 0.0
            rest = _orthogonal(rest / np.linalg.norm(rest), right)
        v = rest / np.linalg.norm(rest)
        betas.append(beta)


def whiten(df: DataFrame, vector: str = "embedding", ident: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per vector that counts and component: ``ident, component, n, deviation, whitened, explained, identity_error``.

    ``component`` numbers the unit eigenvectors of the covariance (divisor n) by falling variance, from 1; ``whitened`` is
    the centred vector along it over its deviation; ``explained`` its share of all variance; ``deviation`` is the exact
    sum of (n*x - S)²; ``identity_error`` is the largest entry of the whitened vectors' covariance minus the identity.
    """
    id_type = df.schema[ident].dataType.simpleString()
    schema = f"`{ident}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    sound = stage(fit_list(df, vector, ident), "whitening-rows")
    common = sound.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims, n = (common["dims"], common["count"]) if common else (0, 0)
    if not dims:
        return df.sparkSession.createDataFrame([], schema)
    rows = sound.where(F.size("x") == dims)
    added = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    sums = np.array([int(r["s"]) for r in sorted(added, key=lambda r: r["i"])], object)

    def centred(x):
        return _centred(x, n, sums).astype(float) / n

    trace = float(_summed(rows, lambda x: np.array([np.square(centred(x)).sum()]), dims)[0]) / n
    if trace <= 0:
        return df.sparkSession.createDataFrame([], schema)

    def product(z):
        def partial(x):
            c = centred(x)
            t = c @ z
            return np.append(c.T @ t, t @ t)

        found = _summed(rows, partial, dims) / n
        return float(found[-1]), found[:-1]

    wanted = min(components, dims)
    sigma, axes = bidiagonalise(product, dims, trace, wanted)
    kept = [k for k in range(wanted) if sigma[k] ** 2 > _FLAT * sigma[0] ** 2]
    variance, turn = np.square(sigma[kept]), axes[kept].T / sigma[kept]
    size = len(kept)

    mean = _summed(rows, lambda x: (centred(x) @ turn).sum(axis=0), dims) / n

    def moments(x):
        w = centred(x) @ turn - mean
        return (w.T @ w).ravel()

    error = float(np.abs(_summed(rows, moments, dims).reshape(size, size) / n - np.eye(size)).max())
    explained = variance / trace
    fits = np.iinfo(np.int64).max

    def project(batches):
        for part, x in _blocks(batches, dims):
            whole = _centred(x, n, sums)
            w = (whole.astype(float) / n) @ turn
            if whole.dtype != object and float(np.abs(whole).max(initial=0)) ** 2 * dims < 2.0**62:
                deviation = pa.array(np.square(whole).sum(axis=1))
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in whole]
                deviation = pa.array([v if v <= fits else None for v in exact], pa.int64())
            each = pa.array(np.repeat(np.arange(len(x)), size))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("id")).take(each),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n, np.int64)),
                    deviation.take(each),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), error)),
                ],
                names=[ident, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
