"""K-means for several k in shared passes over all partitions.

Seeds come from a hash-ranked k-means||: in each round the points with the lowest
``-ln(u) / d2`` are candidates, where u is a hash of the row id and d2 the squared
distance to the candidates so far, so a point is drawn as often as its distance asks
and every run draws the same. Candidates, weighted by the points they are nearest to,
are cut to seeds in the same way; k clusters start from the first k of them.

Coordinates are whole numbers (``whole_points``), so sums are exact and do not depend
on how rows are dealt. A pass assigns points to the centres of every k that still
moves and adds count, vector sum and square sum per k and cluster; only those reach
the driver. The silhouettes of all k come from one more pass with the last sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import materialize

ROUNDS = 20  # passes of Lloyd's algorithm at most
SEED_ROUNDS = 3
OVERSAMPLING = 2  # candidates of a seeding round, times the largest k
BITS = 30  # of a coordinate; fewer above 2 ** 32 rows


@dataclass
class Run:
    """One clustering: centres in whole-number units and what their last pass added up."""

    k: int
    centres: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    squares: np.ndarray


# ------------------------------------------------------------------ points

def _array(features: str) -> Column:
    return F.when(F.col(features).isNotNull(), vector_to_array(features))


def unit_of(points: DataFrame, features: str = "features") -> float:
    """The power of two that turns coordinates into whole numbers of at most ``BITS`` bits."""
    size = F.transform(_array(features), F.abs)
    row = points.agg(F.max(F.array_max(size)).alias("most"), F.count(F.lit(1)).alias("n")).first()
    bits = min(BITS, 62 - max(1, row["n"]).bit_length())
    return 2.0 ** (bits - (math.frexp(row["most"])[1] if row["most"] else 0))


def whole(features: str, unit: float) -> Column:
    return F.transform(_array(features), lambda v: F.floor(v * F.lit(unit) + 0.5).cast("int"))


def whole_points(points: DataFrame, features: str = "features") -> tuple[DataFrame, float]:
    """``id, x array<int>`` of the points with a vector, written once, and their unit."""
    unit = unit_of(points, features)
    rows = points.select("id", whole(features, unit).alias("x")).where("x IS NOT NULL")
    return materialize(rows, "kmeans-points"), unit


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Rows by centres. Where the product form loses its digits the difference is taken."""
    scale = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :]
    out = scale - 2 * (x @ centres.T)
    near = np.argwhere(out < 1e-6 * scale)
    for at in range(0, len(near), 4096):
        i, j = near[at : at + 4096].T
        out[i, j] = ((x[i] - centres[j]) ** 2).sum(axis=1)
    return out


def _batches(points: DataFrame, work: Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work`` makes of the (ids, coordinates) of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work((b.column(0).to_numpy(), _matrix(b.column(1))) for b in batches if b.num_rows)

    return points.select("id", "x").mapInArrow(run, schema)


# ------------------------------------------------------------------ seeds

def hashed(row: int, salt: str, seed: int) -> float:
    """A number above 0 and up to 1: 52 bits of the MD5 of seed, salt and id."""
    digest = hashlib.md5(f"{seed}:{salt}:{row}".encode()).hexdigest()
    return (int(digest[:13], 16) + 1) / 2.0**52


def _drawn(points: DataFrame, chosen: np.ndarray | None, salt: str, count: int, seed: int) -> list[tuple[int, list[int]]]:
    """The ``count`` points that the hash draws, by their distance to ``chosen``; no copies of those."""

    def work(batches):
        best: list[tuple[float, int, np.ndarray]] = []
        for ids, x in batches:
            u = np.fromiter((hashed(i, salt, seed) for i in ids.tolist()), np.float64, len(ids))
            if chosen is None:
                key = u
            else:
                away = squared_distances(x, chosen).min(axis=1)
                key = np.where(away > 0, -np.log(u) / np.where(away > 0, away, 1.0), np.inf)
            order = np.lexsort((ids, key))[:count]
            best += [(key[i], int(ids[i]), x[i]) for i in order if np.isfinite(key[i])]
            best = sorted(best, key=lambda b: b[:2])[:count]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b[0] for b in best], pa.float64()), pa.array([b[1] for b in best], pa.int64()),
                pa.array([b[2].astype(np.int32) for b in best], pa.list_(pa.int32())),
            ],
            ["key", "id", "x"],
        )

    rows = _batches(points, work, "key double, id long, x array<int>").orderBy("key", "id").limit(count).collect()
    return [(r["id"], r["x"]) for r in rows]


def seeds(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """At most ``k`` seeds, in order; fewer if there are fewer different points."""
    found = dict(_drawn(points, None, "first", 1, seed))
    for r in range(SEED_ROUNDS):
        found |= dict(_drawn(points, np.asarray([found[i] for i in sorted(found)], float), f"round{r}", OVERSAMPLING * k, seed))
    ids = sorted(found)
    candidates = np.asarray([found[i] for i in ids], float)

    def work(batches):
        n = np.zeros(len(candidates), np.int64)
        for _, x in batches:
            n += np.bincount(squared_distances(x, candidates).argmin(axis=1), minlength=len(candidates))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n)], ["c", "n"])

    counted = _batches(points, work, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    weight = np.zeros(len(ids))
    for r in counted:
        weight[r["c"]] = r["n"]
    picked: list[int] = []
    away = np.ones(len(ids))
    for j in range(min(k, len(ids))):
        u = np.asarray([hashed(i, f"pick{j}", seed) for i in ids])
        pull = weight * away
        if not pull.any():
            break
        key = np.where(pull > 0, -np.log(u) / np.where(pull > 0, pull, 1.0), np.inf)
        picked.append(int(key.argmin()))
        away = squared_distances(candidates, candidates[picked]).min(axis=1)
    return candidates[picked]


# ------------------------------------------------------------------ fits

def _assigned(x: np.ndarray, centres: np.ndarray, cuts: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each run (a range of the centres) the nearest one of each row; of equals the first."""
    distances = squared_distances(x, centres)
    return [distances[:, a:b].argmin(axis=1) for a, b in cuts]


def _pass(points: DataFrame, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts, vector sums and square sums of the clusters of several sets of centres."""
    stacked = np.concatenate(centres)
    edges = np.cumsum([0, *map(len, centres)]).tolist()
    cuts = list(zip(edges, edges[1:]))
    m, d = stacked.shape

    def work(batches):
        counts, sums, squares = np.zeros(m, np.int64), np.zeros((m, d), np.int64), np.zeros(m)
        for _, x in batches:
            member = np.zeros((len(x), m))
            for (a, _), own in zip(cuts, _assigned(x, stacked, cuts)):
                member[np.arange(len(x)), a + own] = 1.0
            counts += member.sum(axis=0).astype(np.int64)
            sums += (member.T @ x).astype(np.int64)  # whole numbers below 2 ** 53 in a batch
            squares += member.T @ (x * x).sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(m), pa.int32()), pa.array(counts), pa.array(squares), pa.array(list(sums), pa.list_(pa.int64()))],
            ["c", "n", "square", "sums"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            vectors = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, d)
            for c, n, square, vector in zip(*(batch.column(i).to_pylist() for i in range(3)), vectors):
                own = held.setdefault(c, [0, 0.0, np.zeros(d, np.int64)])
                own[0], own[1], own[2] = own[0] + n, own[1] + square, own[2] + vector
        if held:
            n, square, vectors = zip(*held.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array(n, pa.int64()), pa.array(square, pa.float64()), pa.array(vectors, pa.list_(pa.int64()))],
                ["c", "n", "square", "sums"],
            )

    schema = "c int, n long, square double, sums array<long>"
    rows = _batches(points, work, schema).repartition("c").mapInArrow(add, schema).collect()  # one row a centre
    counts, squares, sums = np.zeros(m, np.int64), np.zeros(m), np.zeros((m, d), np.int64)
    for r in rows:
        counts[r["c"]], squares[r["c"]], sums[r["c"]] = r["n"], r["square"], r["sums"]
    return [(counts[a:b], sums[a:b], squares[a:b]) for a, b in cuts]


def fit_runs(points: DataFrame, ks: list[int], most: int, seed: int, rounds: int = ROUNDS) -> list[Run]:
    """A clustering of ``points`` (id, x) for each k, all fitted in the same passes.

    Seeds are drawn for ``most`` clusters, so those of a k do not hang on the others.
    A centre that loses its points stays where it is. A run is done when its centres
    no longer move, or after ``rounds`` passes; its sums belong to its centres.
    """
    first = seeds(points, most, seed)
    runs = [Run(k, first[:k], np.zeros(0), np.zeros(0), np.zeros(0)) for k in ks]
    moving = list(runs)
    for turn in range(rounds):
        still = []
        for run, (counts, sums, squares) in zip(moving, _pass(points, [run.centres for run in moving])):
            run.counts, run.sums, run.squares = counts, sums, squares
            moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], run.centres)
            if turn + 1 < rounds and (moved != run.centres).any():
                run.centres = moved
                still.append(run)
        moving = still
        if not moving:
            break
    return runs


def silhouettes(points: DataFrame, runs: list[Run]) -> list[float]:
    """The mean squared-Euclidean silhouette of every run, from the sums of each, in one pass."""
    stats = [(run.centres, *silhouette_terms(run.counts, run.sums, run.squares)) for run in runs]

    def work(batches):
        totals, n = np.zeros(len(stats)), 0
        for _, x in batches:
            n += len(x)
            for i, (centres, *terms) in enumerate(stats):
                totals[i] += silhouette_of(x, squared_distances(x, centres).argmin(axis=1), *terms).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(stats)), pa.int32()), pa.array(totals), pa.array(np.full(len(stats), n), pa.int64())], ["run", "total", "n"]
        )

    rows = _batches(points, work, "run int, total double, n long").groupBy("run").agg((F.sum("total") / F.sum("n")).alias("s")).collect()
    return [row["s"] for row in sorted(rows, key=lambda r: r["run"])]


def silhouette_terms(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, mean vectors and mean squares of clusters; those of an empty cluster are not numbers."""
    n = np.where(counts > 0, counts, np.nan).astype(float)
    return np.asarray(counts), sums / n[:, None], squares / n


def silhouette_of(x: np.ndarray, own: np.ndarray, counts: np.ndarray, means: np.ndarray, mean_squares: np.ndarray) -> np.ndarray:
    """The silhouette of each row, by mean squared distances to whole clusters; alone in a cluster: 0."""
    used = np.flatnonzero(counts > 0)
    place = np.full(len(counts), -1)
    place[used] = np.arange(len(used))
    to = np.maximum((x * x).sum(axis=1)[:, None] + mean_squares[used][None, :] - 2 * (x @ means[used].T), 0.0)
    rows, mine = np.arange(len(x)), place[own]
    size = counts[own]
    within = to[rows, mine] * size / np.maximum(size - 1, 1)
    to[rows, mine] = np.inf
    other = to.min(axis=1)
    widest = np.maximum(within, other)
    return np.where((size == 1) | (widest == 0), 0.0, (other - within) / np.where(widest > 0, widest, 1.0))
