"""K-means with the number of clusters picked by silhouette."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.vectors import euclidean
from newsloom.operators.kmeans import ROUNDS, fit_runs, silhouettes, squared_distances, whole, whole_points
from newsloom.operators.silhouette import EUCLIDEAN, SQUARED, mean_silhouettes
from newsloom.session import broadcast_if_small, materialize

SEED = 42  # fixed value
MIN_CLUSTERS, MAX_CLUSTERS = 2, 10  # fixed values
#: Centres that a task compares a row with at a time.
CENTRES = 1_000


def nearest(x: Column, centres: np.ndarray) -> Column:
    """The place of the nearest centre to an array column, of equals the first; null without an array."""

    @F.pandas_udf("int")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            given = rows.notna()
            found = pd.Series(pd.NA, index=rows.index, dtype="Int32")
            if given.any():
                found[given] = squared_distances(np.stack(rows[given].to_numpy()).astype(float), centres).argmin(axis=1)
            yield found

    return place(x)


@dataclass
class Clustering:
    """A fitted k-means. ``centres`` are in whole numbers of ``unit``; ``numbers`` maps
    their places to our ids, which follow the lowest row id; ``scores`` maps each
    scored k to its silhouette."""

    centres: np.ndarray
    unit: float
    k: int
    numbers: dict[int, int]
    scores: dict[int, float]

    def assign(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add ``cluster_id``; row by row, so nothing is joined or shuffled."""
        order = [place for place, _ in sorted(self.numbers.items(), key=lambda pair: pair[1])]
        ids = F.array(*[F.lit(self.numbers.get(i)).cast("int") for i in range(len(self.centres))])
        if len(order) == 1:
            return df.withColumn("cluster_id", F.lit(0))
        return df.withColumn("cluster_id", F.get(ids, nearest(whole(features, self.unit), self.centres)))


def number_by_lowest_id(labelled: DataFrame, label: str) -> dict[int, int]:
    """Fitted index -> 0, 1, … in order of the lowest id; one entry per cluster."""
    firsts = labelled.groupBy(label).agg(F.min("id").alias("first")).orderBy("first").collect()
    return {row[label]: i for i, row in enumerate(firsts)}


def _numbered(points: DataFrame, centres: np.ndarray) -> dict[int, int]:
    return number_by_lowest_id(points.select("id", nearest(F.col("x"), centres).alias("place")), "place")


def kmeans(points: DataFrame, k: int, seed: int = SEED, rounds: int = ROUNDS) -> Clustering:
    """K-means for a given k; ``points`` has ``id`` and ``features``."""
    table, unit = whole_points(points)
    run = fit_runs(table, [k], k, seed, rounds)[0]
    return Clustering(run.centres, unit, k, _numbered(table, run.centres), {})


def best_k(scores: dict[int, float], default: int) -> int:
    """Highest score above -1, to 9 places; on a tie the smallest k."""
    best, best_score = default, -1.0
    for k in sorted(scores):
        if round(scores[k], 9) > best_score:
            best, best_score = k, round(scores[k], 9)
    return best


def choose_k(
    points: DataFrame,
    min_clusters: int = MIN_CLUSTERS,
    max_clusters: int = MAX_CLUSTERS,
    seed: int = SEED,
    metric: str = SQUARED,
    rounds: int = ROUNDS,
) -> Clustering:
    """Fit every k and keep the fit with the best mean silhouette, in the given metric.

    All k share the passes of the fit, and one more pass scores them.
    """
    table, unit = whole_points(points)
    n = table.count()
    if n < 2:
        raise ValueError("clustering needs at least 2 samples")
    candidates = list(range(min_clusters, min(max_clusters, n - 1) + 1))
    runs = fit_runs(table, candidates or [min_clusters], max_clusters, seed, rounds)
    used = [run for run in runs if candidates and 2 <= int((run.counts > 0).sum()) <= n - 1]
    scores: dict[int, float] = {}
    if used and metric == EUCLIDEAN:
        labels = F.array(*[nearest(F.col("x"), run.centres) for run in used])
        vectors = materialize(table.select("id", F.transform("x", lambda v: v / F.lit(unit)).alias("vec"), labels.alias("labels")), "labels")
        scores = {used[r["run"]].k: r["silhouette"] for r in mean_silhouettes(vectors, n).collect()}
    elif used:
        scores = {run.k: score for run, score in zip(used, silhouettes(table, used))}
    k = best_k(scores, min_clusters)
    winner = next(run for run in runs if run.k == k)
    return Clustering(winner.centres, unit, k, _numbered(table, winner.centres), scores)


def centroids(points: DataFrame, cluster: str = "cluster_id", features: str = "features") -> DataFrame:
    """``(cluster, centroid array<double>)``: the mean vector of each cluster."""
    return points.groupBy(cluster).agg(
        vector_to_array(Summarizer.mean(F.col(features))).alias("centroid")
    )


def array_features(df: DataFrame, vector: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vector).cast("array<double>")))


def nearest_centroid(
    points: DataFrame, centres: DataFrame, cluster: str = "cluster_id", features: str = "features"
) -> DataFrame:
    """``(id, nearest, distance)``; ties go to the lowest cluster.

    Centres are as many as clusters, a parameter of the fit. They reach the tasks in
    slices of ``CENTRES``, one column of the row's best each.
    """
    rows = centres.select(cluster, "centroid").orderBy(cluster).collect()
    kind = centres.schema[cluster].dataType.simpleString()
    best = []
    for start in range(0, len(rows), CENTRES):
        some = rows[start : start + CENTRES]
        table = np.asarray([r["centroid"] for r in some], float)
        best.append(_nearest_of(vector_to_array(features), table, [r[cluster] for r in some], kind))
    found = points.select("id", (best[0] if len(best) == 1 else F.least(*best)).alias("best"))
    return found.select("id", F.col("best.c").alias("nearest"), F.col("best.d").alias("distance"))


def _nearest_of(x: Column, centres: np.ndarray, ids: list, kind: str) -> Column:
    @F.pandas_udf(f"d double, c {kind}")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            rows = np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, centres.shape[1]))
            at = squared_distances(rows, centres).argmin(axis=1)
            yield pd.DataFrame({"d": np.sqrt(((rows - centres[at]) ** 2).sum(axis=1)), "c": [ids[i] for i in at]})

    return place(x)


def representatives(
    points: DataFrame, centres: DataFrame, summary: str = "summary",
    cluster: str = "cluster_id", features: str = "features",
) -> DataFrame:
    """``(cluster, id, distance, summary)`` of the row nearest to its centroid.

    On equal distance the lowest id wins; clusters without rows are absent. The
    minimum is folded per task, and the summary is looked up for winners only.
    """
    centres = materialize(centres.select(cluster, "centroid"), "centres")
    measured = points.join(broadcast_if_small(centres), cluster).select(
        cluster, "id", euclidean(vector_to_array(features), F.col("centroid")).alias("distance")
    )
    least = measured.groupBy(cluster).agg(
        F.min_by(F.struct("id", "distance"), F.struct("distance", "id")).alias("_w")
    )
    winners = materialize(
        least.select(cluster, F.col("_w.id").alias("id"), F.col("_w.distance").alias("distance")),
        "representatives",
    )
    return points.select("id", summary).join(broadcast_if_small(winners), "id").select(
        cluster, "id", "distance", summary
    )
