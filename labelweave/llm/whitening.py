"""Whitening of embeddings by spectral divide and conquer with QDWH polar decompositions.

Embeddings become integer vectors, and each distinct one counts once in the statistics. One pass over these
sums them exactly, a second sums products of centred vectors into the covariance: a matrix whose size depends
on the number of dimensions only, so it fits the driver. There the polar factor of the shifted covariance
tells the eigenvalues above the shift from those below: half of factor plus identity is the projector on the
invariant subspace above. Both subspaces are split in turn until all are single components. The matrix of
scaled components is broadcast to whiten every row.

The polar factor comes from the QR-based dynamically weighted Halley iteration (Nakatsukasa, Bai, Gygi 2010;
Nakatsukasa, Higham 2013), which needs no inverse and at most six or seven steps.

Defined cases: rows whose vector is NULL, empty, holds a NULL or non-finite entry, or an entry of 2^46 or more
are dropped, as are rows whose length is not the commonest one (the greater of equally common ones); equal
vectors count once and are all returned; a NULL key stays; components without variance (an eigenvalue below
rounding of the largest) are left out, so equal vectors alone, or a single row, give no rows; ``deviation`` is
NULL where it does not fit a long; extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.rows import release
from labelweave.scratch import settle

_EPS = float(np.finfo(float).eps)
#: Entries are multiplied by SCALE, rounded down and moved by OFFSET.
SCALE = 64
OFFSET = 1_000_000
#: Largest magnitude of a scaled entry that a double holds with its unit.
_LARGEST = float(1 << 52)


# Polar decomposition and splitting, on one small symmetric matrix.


def polar_factor(a: np.ndarray, steps: int = 30) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix without eigenvalue 0 (its matrix sign)."""
    size = len(a)
    x = a / np.linalg.norm(a)
    # The weights need a lower bound of the least singular value; one too small only costs steps.
    low = max(np.abs(np.diag(np.linalg.qr(x, mode="r"))).min() / size, _EPS)
    for _ in range(steps):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        h = math.sqrt(1 + d) + 0.5 * math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * math.sqrt(1 + d))))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(c) * x, np.eye(size)]))
        moved = b / c * x + (h - b / c) / math.sqrt(c) * (q[:size] @ q[size:].T)
        moved = (moved + moved.T) / 2
        change = np.linalg.norm(moved - x)
        x, low = moved, min(1.0, low * (h + b * square) / (1 + c * square))
        if change < np.cbrt(_EPS) and 1 - low < 1e-10:
            break
    return x


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Values between the least and the greatest eigenvalue, the middle of the diagonal first."""
    diagonal = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.diag(np.diag(a))) + (diagonal[-1] - diagonal[0])
    yield float(np.median(diagonal))
    yield float(diagonal.mean())
    for step in range(1, 40):
        # Off the diagonal's middle by growing parts of the spread, to either side.
        yield float(diagonal.mean() + (-1) ** step * spread * 0.37 * 0.7 ** (40 - step))


def split(a: np.ndarray, seed: int) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns span the subspace of the greater eigenvalues, and their number.

    None if no shift parts the eigenvalues: they are equal to rounding.
    """
    size = len(a)
    noise = np.random.default_rng(seed).standard_normal((size, size))
    norm = np.linalg.norm(a)
    for shift in _shifts(a):
        moved = a - shift * np.eye(size)
        if np.linalg.norm(moved) <= 4 * _EPS * size * norm:
            continue
        projector = (polar_factor(moved) + np.eye(size)) / 2
        above = round(float(np.trace(projector)))
        if not 0 < above < size or abs(np.trace(projector) - above) > 1e-6:
            continue
        basis = np.hstack([projector @ noise[:, :above], noise[:, above:] - projector @ noise[:, above:]])
        for _ in range(2):  # again on a good basis, so that the first multiplication's noise does no harm
            basis, _ = np.linalg.qr(basis)
            basis = np.hstack([projector @ basis[:, :above], basis[:, above:] - projector @ basis[:, above:]])
        basis, _ = np.linalg.qr(basis)
        if np.linalg.norm(basis[:, above:].T @ a @ basis[:, :above]) <= 50 * _EPS * size * norm:
            return basis, above
    return None


def spectral_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix."""
    norm = float(np.linalg.norm(a))
    values, vectors = np.zeros(len(a)), np.zeros_like(a, dtype=float)
    done = 0
    # Greater eigenvalues lie on top of the stack, so that components come out almost in order.
    stack = [np.eye(len(a))]
    while stack:
        basis = stack.pop()
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        found = split(part, len(stack)) if len(part) > 1 else None
        off = np.linalg.norm(part - np.diag(np.diag(part)))
        if len(part) > 1 and found is not None and off > _EPS * norm:
            own, above = found
            stack += [basis @ own[:, above:], basis @ own[:, :above]]
            continue
        values[done : done + len(part)] = np.diag(part)
        vectors[:, done : done + len(part)] = basis
        done += len(part)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    return values[order], vectors


# Statistics of the distinct vectors, and whitening, in tasks.


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dims)


def _sum_batches(dims: int):
    """Rows and exact sums of a task, the sums as digits, since they may exceed a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = 0, np.zeros(dims, dtype=object)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            safe = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
            rows, sums = rows + len(x), sums + (x if safe else x.astype(object)).sum(axis=0)
        if rows:
            digits = pa.array([[str(v) for v in sums]])
            yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), digits], ["n", "sums"])

    return run


def _product_batches(n: int, sums: np.ndarray, whitener: np.ndarray | None):
    """A task's sum of products of centred (and whitened) vectors, entry by entry."""
    dims = len(sums)
    size = dims if whitener is None else whitener.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros((size, size)), False
        for batch in batches:
            rows = (centred(_matrix(batch.column(0), dims), n, sums) / n).astype(float)
            if whitener is not None:
                rows = rows @ whitener
            total, met = total + rows.T @ rows, met or len(rows) > 0
        if met:
            i, j = np.divmod(np.arange(size * size, dtype=np.int32), np.int32(size))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])
        release()

    return run


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exact as long as it fits a long, else in the exact integers of Python."""
    largest = max(int(np.abs(x).max(initial=0)), 1)
    if largest * n < 1 << 62:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def covariance(fit: DataFrame, n: int, sums: np.ndarray, whitener: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the vectors, or of their whitened form, whose mean is zero like theirs."""
    size = len(sums) if whitener is None else whitener.shape[1]
    parts = fit.mapInArrow(_product_batches(n, sums, whitener), "i int, j int, v double")
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    return (out + out.T) / 2 / n


def _white_batches(n: int, sums: np.ndarray, whitener: np.ndarray):
    """Key, exact squared deviation, and the whitened vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = centred(_matrix(batch.column(1), len(sums)), n, sums)
            white = (away / n).astype(float) @ whitener
            offsets = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), squared(away), lists], ["key", "deviation", "white"])
        release()

    return run


def squared(away: np.ndarray) -> pa.Array:
    """Sum of squares of each row as a long; NULL where it does not fit."""
    largest = max((abs(int(v)) for v in (away.min(initial=0), away.max(initial=0))), default=0)
    if largest * largest * away.shape[1] < 1 << 63:
        small = away.astype(np.int64)
        return pa.array((small * small).sum(axis=1))
    exact = [sum(int(v) ** 2 for v in row) for row in away]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


@dataclass(frozen=True)
class Whitening:
    """Statistics of the distinct vectors, components (columns, greatest variance first) and their whitener."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    components: np.ndarray
    identity_error: float

    @property
    def whitener(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def usable(vector: Column) -> Column:
    """Whether all entries are finite and small enough."""
    bad = F.exists(vector, lambda c: c.isNull() | ~(F.abs(c.cast("double") * SCALE) < _LARGEST))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def integer_vectors(table: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Stored (key, x) of the usable rows, and their number of dimensions."""
    entry = lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET
    given = table.filter(usable(table[vector]))
    rows = settle(given.select(table[key].alias("key"), F.transform(table[vector], entry).alias("x")), "vectors")
    common = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dims = common["size"] if common else 0
    return rows.filter(F.size("x") == dims), dims


def fit_whitening(rows: DataFrame, dims: int, components: int) -> Whitening | None:
    """Fit on the distinct ``x`` of the rows; None if there is no variance.

    Copies meet in the map tasks first, so a vector that a third of all rows share is sent once by each task.
    The driver gets sums and products of ``dims`` and ``dims`` x ``dims`` numbers.
    """
    fit = settle(rows.select("x").distinct(), "distinct_vectors")
    parts = fit.mapInArrow(_sum_batches(dims), "n long, sums array<string>")
    wide = parts.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    )
    found = sorted(wide.collect())
    n = int(found[0]["n"]) if found else 0
    if not n:
        return None
    totals = [int(r["s"]) for r in found]
    sums = np.array(totals, dtype=np.int64 if max(map(abs, totals)) < 1 << 62 else object)
    spread = covariance(fit, n, sums)
    values, vectors = spectral_components(spread)
    kept = int((values[:components] > max(values[0], 0.0) * dims * 4 * _EPS).sum())
    if not kept:
        return None
    values, vectors = values[:kept], vectors[:, :kept]
    whitener = vectors / np.sqrt(values)
    error = covariance(fit, n, sums, whitener) - np.eye(kept)
    return Whitening(n, sums, values, values / np.trace(spread), vectors, float(np.abs(error).max()))


def whiten(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    rows, dims = integer_vectors(table, key, vector)
    kind = table.schema[key].dataType.simpleString()
    model = fit_whitening(rows, dims, components) if dims else None
    if model is None:
        empty = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return table.sparkSession.createDataFrame([], empty)
    schema = f"key {kind}, deviation long, white array<double>"
    white = rows.mapInArrow(_white_batches(model.n, model.sums, model.whitener), schema)
    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    each = white.select("key", "deviation", F.posexplode("white").alias("at", "whitened"))
    return each.select(
        F.col("key").alias(key),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
