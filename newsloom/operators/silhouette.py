"""Mean silhouette of one or several clusterings of the same points."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.kmeans import silhouette_of, silhouette_terms
from newsloom.session import materialize

SQUARED, EUCLIDEAN = "squared_euclidean", "euclidean"
BLOCK = 2048

#: A table that makes more blocks than this has them larger, up to ``BLOCK`` rows.
BLOCKS = 64
#: Bytes of a block's vectors at most: two of them make a row of the cross product.
BLOCK_BYTES = 2 << 20
#: Parts of the right side. Each left row leaves one row of sums per part, run and
#: cluster, so this number is fixed and the shuffle grows as the table does.
PARTS = 4

_BLOCKS = "number long, ids array<long>, labels array<array<int>>, codes array<int>, dimensions int, x binary"
_SUMS = "id long, run int, own boolean, cluster int, total double, n long"


def _packed(points: DataFrame, block: int) -> DataFrame:
    """``points`` as rows of at most ``block`` points each, every different vector of a block once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            rows = max(1, min(block, BLOCK_BYTES // max(1, 8 * x.shape[1])))
            for start in range(0, len(x), rows):
                places: dict[bytes, int] = {}
                codes = [places.setdefault(row.tobytes(), len(places)) for row in x[start : start + rows]]
                own = batch.slice(start, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()), pa.array([own.column(0).to_pylist()], pa.list_(pa.int64())),
                        pa.array([own.column(2).to_pylist()], pa.list_(pa.list_(pa.int32()))), pa.array([codes], pa.list_(pa.int32())),
                        pa.array([x.shape[1]], pa.int32()), pa.array([b"".join(places)], pa.binary()),
                    ],
                    ["number", "ids", "labels", "codes", "dimensions", "x"],
                )
                number += 1

    return points.select("id", "vec", "labels").mapInArrow(run, _BLOCKS)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of every x to every y. Close pairs lose their digits in the product form and are measured directly."""
    scale = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    squares = x @ y.T
    squares *= -2
    squares += scale
    scale *= 1e-6
    close = np.argwhere(squares < scale)
    for at in range(0, len(close), 4096):
        i, j = close[at : at + 4096].T
        squares[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(squares, 0.0, out=squares), out=squares)


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of a left and a right block the sums of each left block, added up while it stays the same."""
    number, left = None, None
    held: dict[tuple[int, int], list] = {}  # run and cluster: totals of the left vectors, members

    def out() -> pa.RecordBatch:
        ids, labels, codes = left[0], left[1], left[2]
        groups = sorted(held)
        run, cluster = (np.asarray(values) for values in zip(*groups))
        totals = np.stack([held[g][0] for g in groups], axis=1)[codes]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids).take(pa.array(np.repeat(np.arange(len(codes)), len(groups)))), pa.array(np.tile(run, len(codes)), pa.int32()),
                pa.array((labels[:, run] == cluster[None, :]).ravel()), pa.array(np.tile(cluster, len(codes)), pa.int32()),
                pa.array(totals.ravel()), pa.array(np.tile([held[g][1] for g in groups], len(codes)), pa.int64()),
            ],
            ["id", "run", "own", "cluster", "total", "n"],
        )

    def block(batch: pa.RecordBatch, row: int, at: int) -> tuple:
        ids, labels, codes, dimensions, x = (batch.column(at + i)[row] for i in range(5))
        vectors = np.frombuffer(x.as_buffer(), np.float64).reshape(-1, dimensions.as_py())
        return ids.values, np.asarray(labels.as_py(), np.int64), codes.values.to_numpy(), vectors

    for batch in batches:
        for row in range(batch.num_rows):
            if number != batch.column(0)[row].as_py():
                if held:
                    yield out()
                number, left, held = batch.column(0)[row].as_py(), block(batch, row, 1), {}
            _, labels, codes, y = block(batch, row, 6)
            members = []
            for run in range(labels.shape[1]):
                for cluster in np.unique(labels[:, run]).tolist():
                    members.append((run, cluster, np.bincount(codes[labels[:, run] == cluster], minlength=len(y))))
            totals = _distances(left[3], y) @ np.stack([m for *_, m in members], axis=1).astype(float)
            for (run, cluster, m), total in zip(members, totals.T):
                own = held.setdefault((run, cluster), [0.0, 0])
                own[0], own[1] = own[0] + total, own[1] + int(m.sum())
    if held:
        yield out()


def distance_sums(points: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """Per point, clustering and cluster: the sum of Euclidean distances to the members.

    ``points`` has ``id``, ``vec array<double>`` and ``labels array<int>``, one
    label per clustering. Points are packed into blocks of at most ``block`` rows
    (large tables: up to ``BLOCK``), written once. Every two blocks meet in a cross
    product of the two sides' partitions, which reads blocks again and shuffles none
    of them: time is quadratic, disk is not. No pair of points leaves its task, only
    sums, and all clusterings share the same distances.
    """
    block = max(block, min(BLOCK, n // BLOCKS))
    blocks = materialize(_packed(points, block), "silhouette-blocks")
    wide = 2 * points.sparkSession.sparkContext.defaultParallelism
    left = blocks.repartition(max(1, min(wide, math.ceil(n / block))))
    columns = ["ids", "labels", "codes", "dimensions", "x"]
    right = blocks.select(*[F.col(c).alias(f"{c}_r") for c in columns]).repartition(PARTS)
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)
    sums = pairs.select("number", *columns, *[f"{c}_r" for c in columns]).mapInArrow(_block_sums, _SUMS)
    return sums.groupBy("id", "run", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def silhouette_samples(points: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """``(run, id, s)``: the silhouette of each point. A point alone in its cluster has 0."""
    sums = distance_sums(points, n, block)
    own, total, count = F.col("own"), F.col("total"), F.col("n")
    per_point = sums.groupBy("run", "id").agg(
        F.max(F.when(own, count)).alias("size"),
        F.max(F.when(own, total)).alias("within"),
        F.min(F.when(~own, total / count)).alias("b"),
    )
    a = F.col("within") / (F.col("size") - 1)
    widest = F.greatest(a, F.col("b"))
    s = F.when((F.col("size") == 1) | (widest == 0), 0.0).otherwise((F.col("b") - a) / widest)
    return per_point.select("run", "id", F.when(F.col("b").isNotNull(), s).alias("s"))


def mean_silhouettes(points: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """``(run, silhouette)``, Euclidean and exact; null for a run with one cluster."""
    return silhouette_samples(points, n, block).groupBy("run").agg(
        F.avg("s").alias("silhouette")
    )


def mean_silhouettes_squared(
    points: DataFrame, features: str, label_columns: list[str]
) -> Iterator[tuple[int, float]]:
    """``(run, silhouette)`` of the squared-Euclidean form for several labelings at once.

    One aggregate adds count, vector sum and square sum per labeling and cluster, one
    pass over the points scores all labelings with them: the cost is linear in the
    number of points. A null label leaves the row out of its labeling.
    """
    vec = vector_to_array(features)
    pairs = F.array(*[F.struct(F.lit(i).alias("run"), F.col(c).cast("int").alias("cluster")) for i, c in enumerate(label_columns)])
    square = F.aggregate(vec, F.lit(0.0), lambda s, v: s + v * v)
    members = points.select(F.col(features).alias("v"), square.alias("square"), F.inline(pairs)).where("cluster IS NOT NULL")
    rows = members.groupBy("run", "cluster").agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(F.col("v"))).alias("sums"), F.sum("square").alias("square")
    ).collect()  # a row per labeling and cluster
    stats = []
    for run in range(len(label_columns)):
        own = sorted((r for r in rows if r["run"] == run), key=lambda r: r["cluster"])
        places = {r["cluster"]: i for i, r in enumerate(own)}
        terms = silhouette_terms(np.asarray([r["n"] for r in own]), np.asarray([r["sums"] for r in own], float), np.asarray([r["square"] for r in own], float))
        stats.append((places, terms))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(len(stats)), np.zeros(len(stats), np.int64)
        for batch in batches:
            x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
            for run, (places, terms) in enumerate(stats):
                if len(places) < 2:
                    continue
                labels = batch.column(run + 1).to_pylist()
                given = np.asarray([label is not None for label in labels], bool)
                own = np.asarray([places[label] for label in labels if label is not None], int)
                totals[run] += silhouette_of(x[given], own, *terms).sum()
                counts[run] += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(stats)), pa.int32()), pa.array(totals), pa.array(counts)], ["run", "total", "n"])

    scored = points.select(vec.alias("x"), *[F.col(c).cast("int").alias(f"l{i}") for i, c in enumerate(label_columns)])
    sums = scored.mapInArrow(score, "run int, total double, n long").groupBy("run").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    for r in sorted(sums.collect(), key=lambda r: r["run"]):
        yield r["run"], r["total"] / r["n"] if r["n"] else float("nan")


def silhouette(
    points: DataFrame, features: str = "features", label: str = "cluster_id",
    metric: str = SQUARED, block: int = BLOCK,
) -> DataFrame:
    """One row ``(metric, n, silhouette)`` for points with ``id``, vectors and labels.

    ``metric`` decides the form at every size: the squared one is linear in the
    number of points, the Euclidean one needs every distance.
    """
    n = points.count()
    if metric == EUCLIDEAN:
        vectors = points.select(
            "id", vector_to_array(features).alias("vec"),
            F.array(F.col(label).cast("int")).alias("labels"),
        )
        return mean_silhouettes(vectors, n, block).select(
            F.lit(EUCLIDEAN).alias("metric"), F.lit(n).cast("long").alias("n"), "silhouette"
        )
    score = dict(mean_silhouettes_squared(points, features, [label]))[0]
    return points.sparkSession.createDataFrame(
        [(SQUARED, n, float(score))], "metric string, n long, silhouette double"
    )
