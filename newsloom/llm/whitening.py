"""Whitening of embeddings by eigenvectors refined from single to double precision.

The covariance is summed over all partitions. Its eigenvectors are found in float32
and then corrected by Ogita-Aishima iterations, which need matrix products only: the
products are made of slices whose partial products are exact in float64, so that the
residuals keep their digits. Eigenvalues too near to each other for the iteration are
a cluster, whose basis a small eigenproblem of its own turns (the sub-solve).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import materialize

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this, times SCALE, count as this: sums of what remains stay exact.
LARGEST = 1 << 52
SWEEPS = 12
#: Rows that a task turns into output at a time.
ROWS = 2_048
SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


# ------------------------------------------------------------------ eigenvectors

def _slices(a: np.ndarray, axis: int, bits: int) -> list[np.ndarray]:
    """``a`` as a sum of three matrices, the first two with ``bits`` bits a number, per row or column."""
    out, rest = [], a
    for _ in range(2):
        largest = np.abs(rest).max(axis=axis, keepdims=True, initial=0.0)
        unit = np.where(largest > 0, np.exp2(np.ceil(np.log2(np.where(largest > 0, largest, 1.0))) + 53 - bits), 0.0)
        top = (rest + unit) - unit
        out.append(top)
        rest = rest - top
    return [*out, rest]


def product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a @ b`` as a sum of two float64 matrices, to about twice the digits of one."""
    bits = int((53 - np.ceil(np.log2(max(2, a.shape[1])))) // 2)
    high, low = np.zeros((a.shape[0], b.shape[1])), np.zeros((a.shape[0], b.shape[1]))
    left, right = _slices(a, 1, bits), _slices(b, 0, bits)
    for i, j in sorted(np.ndindex(3, 3), key=sum):
        term = left[i] @ right[j]
        total = high + term
        part = total - high
        low += (high - (total - part)) + (term - part)
        high = total
    total = high + low
    return total, low - (total - high)


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of sorted ``values`` that follow each other by no more than ``gap``, two or more."""
    cut = np.flatnonzero(np.diff(values) > gap) + 1
    return [places for places in np.split(np.arange(len(values)), cut) if len(places) > 1]


def eigenvectors(matrix: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Of each vector the entry of largest size is positive. Inside a cluster of equal
    eigenvalues the vectors are an orthonormal basis, as any such basis is right.
    """
    size = float(np.abs(matrix).max(initial=0.0))
    if not size:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    a = (matrix + matrix.T) / (2 * size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    eye, norm, before = np.eye(len(a)), np.linalg.norm(a), np.inf
    for _ in range(sweeps):
        high, low = product(x.T, x)
        r = (eye - high) - low
        y, y_low = product(a, x)
        high, low = product(x.T, y)
        low = low + x.T @ y_low
        s = high + low
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(values, kind="stable")
        x, r, values = x[:, order], r[np.ix_(order, order)], values[order]
        high, low, s = (m[np.ix_(order, order)] for m in (high, low, s))
        gap = 2 * (np.linalg.norm(s - np.diag(values)) + norm * np.linalg.norm(r))
        apart = values[None, :] - values[:, None]
        far = np.abs(apart) > gap
        e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1.0), r / 2)
        turn = eye.copy()
        moved = float(np.abs(e).max())
        for places in _clusters(values, gap):
            at = np.ix_(places, places)
            middle = float(values[places].mean())
            inner = (high[at] - middle * np.eye(len(places))) + low[at] + middle * r[at]
            e[at] = r[at] / 2
            basis = np.linalg.eigh((inner + inner.T) / 2)[1]
            moved = max(moved, float(np.abs(np.abs(basis) - np.eye(len(places))).max()) * (moved > 1e-15))
            turn[at] = basis
        x = (x + x @ e) @ turn
        if moved < 4e-16 or (moved >= before and moved < 1e-13):
            break
        before = moved
    values = np.einsum("ij,ij->j", x, product(a, x)[0]) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.linalg.norm(x[:, order], axis=0)
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])])
    return values[order] * size, x * np.where(sign == 0, 1.0, sign)


# ------------------------------------------------------------------ the fit

class Whitener(NamedTuple):
    """Exact means (``whole + part / n`` per dimension) and scaled eigenvectors of a fit list."""

    n: int
    whole: np.ndarray  # int64
    part: np.ndarray  # int64, 0 to n - 1
    columns: np.ndarray  # dimensions x components, over the root of the eigenvalue
    explained: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.columns

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row the sum over dimensions of (n * x - S) ** 2, exact; None if no long can hold it."""
        away = x - self.whole
        reach = (int(np.abs(away).max(initial=0)) + 1) * self.n
        if reach * reach * max(1, x.shape[1]) < 1 << 63:
            return ((away * self.n - self.part) ** 2).sum(axis=1).tolist()
        exact = away.astype(object) * self.n - self.part.astype(object)
        sums = (exact * exact).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in sums]


def _whole_numbers(column: pa.Array, dimensions: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(-1, dimensions) + SHIFT


def _packed(x: np.ndarray) -> bytes:
    """The bytes of a vector, four a number where that holds them all."""
    narrow = x.astype(np.int32)
    return (narrow if (narrow == x).all() else x).tobytes()


def _unpacked(column: pa.Array, dimensions: int) -> np.ndarray:
    rows = [np.frombuffer(v, dtype=np.int32 if len(v) == 4 * dimensions else np.int64) for v in column.to_pylist()]
    return np.asarray(rows, dtype=np.int64).reshape(-1, dimensions)


def complete(vectors: DataFrame, id_column: str, column: str) -> tuple[DataFrame, int]:
    """``vec_id, vector`` of the rows whose vector has no null, NaN or infinite entry, and its length.

    Vectors of another length than most have (of equals the longer) are left out.
    """
    entry_fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).where(F.forall("vector", entry_fits))
    commonest = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimensions = commonest["d"] if commonest else 0
    return rows.where(F.size("vector") == dimensions), dimensions


def _distinct(rows: DataFrame, dimensions: int) -> DataFrame:
    """Each distinct whole-number vector once, packed; copies fold in their task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = {_packed(x) for x in _whole_numbers(batch.column(0), dimensions)}
            yield pa.RecordBatch.from_arrays([pa.array(list(packed), pa.binary())], ["x"])

    return rows.select("vector").mapInArrow(run, "x binary").distinct()


def _exact_sums(x: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """Rows and per-dimension sums: two halves of each number are added apart, so that no sum overflows."""
    half = 26

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dimensions, dtype=np.int64), np.zeros(dimensions, dtype=np.int64)
        for batch in batches:
            own = _unpacked(batch.column(0), dimensions)
            n, high, low = n + len(own), high + (own >> half).sum(axis=0), low + (own & ((1 << half) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dimensions), pa.int32()), pa.array(np.full(dimensions, n), pa.int64()), pa.array(high), pa.array(low)],
            ["i", "n", "high", "low"],
        )

    parts = x.mapInArrow(run, "i int, n long, high long, low long")
    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    rows = parts.groupBy("i").agg(*wide).orderBy("i").collect()  # one row a dimension
    return (int(rows[0]["n"]) if rows else 0), [(int(r["high"]) << half) + int(r["low"]) for r in rows]


def _moments(x: DataFrame, dimensions: int, centred, width: int) -> np.ndarray:
    """The sum of outer products of ``centred`` rows: a matrix per task, its rows added by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            own = centred(_unpacked(batch.column(0), dimensions))
            total += own.T @ own
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = np.asarray(batch.column(1).flatten().to_numpy()).reshape(-1, width)
            for i, row in zip(batch.column(0).to_pylist(), rows):
                sums[i] = sums[i] + row if i in sums else row.copy()
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "row"]
            )

    schema = "i int, row array<double>"
    rows = x.mapInArrow(run, schema).repartition("i").mapInArrow(add, schema).collect()  # one row a dimension
    out = np.zeros((width, width))
    for r in rows:
        out[r["i"]] = r["row"]
    return out


def fit(rows: DataFrame, dimensions: int, components: int = 16) -> Whitener | None:
    """Fit on the distinct vectors of ``rows`` (vector, all of ``dimensions`` numbers); None without any.

    Directions in which the fit list does not vary give no component. The matrix
    (dimensions squared) is all that reaches the driver.
    """
    x = materialize(_distinct(rows, dimensions), "whitening-vectors")
    n, sums = _exact_sums(x, dimensions) if dimensions else (0, [])
    if not n:
        return None
    whole = np.asarray([s // n for s in sums], dtype=np.int64)
    part = np.asarray([s % n for s in sums], dtype=np.int64)
    centre = Whitener(n, whole, part, np.zeros((dimensions, 0)), np.zeros(0), 0.0)
    covariance = _moments(x, dimensions, centre.centred, dimensions) / n
    values, vectors = eigenvectors(covariance)
    varies = values > 8 * dimensions * np.finfo(np.float64).eps * max(values.max(), 0.0)
    kept = int(varies[:components].sum())
    fitted = centre._replace(
        columns=vectors[:, :kept] / np.sqrt(values[:kept]), explained=values[:kept] / max(np.trace(covariance), np.finfo(np.float64).tiny)
    )
    if not kept:
        return fitted
    with_one = lambda own: np.column_stack([fitted.whitened(own), np.ones(len(own))])
    moments = _moments(x, dimensions, with_one, kept + 1) / n  # the last column holds the means
    measured = moments[:kept, :kept] - np.outer(moments[:kept, kept], moments[:kept, kept])
    return fitted._replace(identity_error=float(np.abs(measured - np.eye(kept)).max()))


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = 16) -> DataFrame:
    """Whitened coordinates of every row, up to ``components`` a row.

    Entries become whole numbers floor(64 * c) + 1,000,000 (of at most 2^52 before
    the shift). The fit list holds each distinct such vector once, so copies weigh
    nothing; n is its length, S its sums. Returns ``vec_id, component, n, deviation,
    whitened, explained, identity_error``: components are numbered from 1 by falling
    eigenvalue, ``deviation`` is the sum of (n * x - S) ** 2 (null beyond a long),
    ``identity_error`` the largest entry of the whitened fit list's covariance less
    the identity, measured over that list. Rows whose vector is null, empty, or holds
    null, NaN or infinite entries are left out, as are vectors of another length than
    most have. Rows with a null id and repeated rows stay, one result each. With fewer
    distinct directions than components there are fewer rows; an empty table, or one
    without any variance, gives none. Other columns are ignored.
    """
    rows, dimensions = complete(vectors, id_column, column)
    model = fit(rows, dimensions, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    kept = model.columns.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                ids, own = batch.column(0).slice(start, ROWS), batch.column(1).slice(start, ROWS)
                x = _whole_numbers(own, dimensions)
                each = np.repeat(np.arange(len(x)), kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, kept + 1), len(x)), pa.int32()),
                        pa.array(np.full(len(each), model.n), pa.int64()), pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                        pa.array(model.whitened(x).ravel(), pa.float64()), pa.array(np.tile(model.explained, len(x)), pa.float64()),
                        pa.array(np.full(len(each), model.identity_error), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, SCHEMA)
