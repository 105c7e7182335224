"""Approximate nearest neighbours by collision counting on single projections.

Vectors and queries meet in blocks of bounded size. A block holds vectors of
similar norm, so that those left over by lifting them to equal length are short,
and every query meets the blocks of all norms. In a block every projection is a
sorted array; a query's windows grow around its own values (virtual
rehashing) until enough vectors lie in the windows of enough projections, and
those are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import broadcast_if_small, materialize

PROJECTIONS = 128
#: A vector collides often enough in so many of the projections.
THRESHOLD = 0.65
#: Norms of a block differ by this factor at most.
BAND = 1.1
#: Half width of the first windows, and their growth; in units of the longest vector of the block.
FIRST, GROWTH = 0.9, 1.06
#: So much of a block is compared exactly for a query, at least.
VERIFIED = 0.2
LEAST = 320
#: Rows of a block of vectors and of queries.
BLOCK, QUERY_BLOCK = 8_192, 1_024
SEED = 11


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vector, size) of rows with finite, non-zero vectors; one row per key."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(good & some)
    return kept.withColumn("size", F.size("vector")).dropDuplicates(["vec_id"])


class SortedProjections:
    """One block: projections of its vectors, each as a sorted array, and the queries that meet it."""

    def __init__(self, vectors: np.ndarray, queries: np.ndarray):
        self._vectors, self._queries = vectors, queries
        squares = (vectors**2).sum(axis=1)
        longest = float(np.sqrt(squares.max())) * (1 + 1e-12)
        rest = np.sqrt(np.maximum(longest**2 - squares, 0))
        axes = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        values = np.c_[vectors, rest] @ axes  # equal lengths: the nearest has the largest product
        order = np.argsort(values, axis=0, kind="stable")
        self._sorted = np.take_along_axis(values, order, axis=0).T.copy()
        #: Where each vector stands in each sorted array; a window is a range of these.
        self._places = np.empty(values.T.shape, dtype=np.uint32 if len(values) >= 1 << 16 else np.uint16)
        for places, own in zip(self._places, order.T):
            places[own] = np.arange(len(own))
        self._centres = (queries * (longest / np.linalg.norm(queries, axis=1))[:, None] @ axes[:-1]).T
        self._longest = longest
        self._level = 0
        self._ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._shifted, self._inside = np.empty_like(self._places), np.empty(self._places.shape, dtype=bool)

    def _windows(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First place and width of every query's windows, a row per query, at a level."""
        if level not in self._ranges:
            half = FIRST * self._longest * GROWTH**level
            ends = [(np.searchsorted(v, c - half), np.searchsorted(v, c + half)) for v, c in zip(self._sorted, self._centres)]
            low, high = (np.stack(e, axis=1) for e in zip(*ends))
            self._ranges[level] = low.astype(self._places.dtype), (high - low).astype(self._places.dtype)
        return self._ranges[level]

    def _collisions(self, q: int, level: int) -> np.ndarray:
        """In how many projections each vector lies in the query's window."""
        low, width = self._windows(level)
        np.subtract(self._places, low[q][:, None], out=self._shifted)  # below ``low`` it wraps around
        np.less(self._shifted, width[q][:, None], out=self._inside)
        return np.add.reduce(self._inside.view(np.uint8), axis=0, dtype=np.uint8)

    def candidates(self, q: int) -> np.ndarray:
        """Indices of vectors with enough collisions: windows grow until these are enough.

        The windows begin as the query before has left them, one step narrower
        if that one found half as many again as it wanted.
        """
        n = len(self._vectors)
        wanted = max(LEAST, int(np.ceil(VERIFIED * n)))
        if n <= wanted:
            return np.arange(n)
        while True:
            found = np.flatnonzero(self._collisions(q, self._level) >= THRESHOLD * PROJECTIONS)
            if len(found) >= wanted:
                self._level = max(0, self._level - (2 * len(found) > 3 * wanted))
                return found
            self._level += 1

    def best(self, q: int, at: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the ``k`` nearest of the vectors ``at``, ties to the smaller id.

        A matrix product, whose last bits vary with the place of a row, leaves out
        what is clearly behind; products summed alike for all rows decide.
        """
        query = self._queries[q]
        if len(at) > k:
            about = self._vectors[at] @ query
            slack = 1e-9 * self._longest * np.linalg.norm(query)
            at = at[about >= np.partition(about, -k)[-k] - slack]
        score = (self._vectors[at] * query).sum(axis=1)
        order = np.lexsort((ids[at], -score))[:k]
        return ids[at][order], score[order]


def nearest(rows: DataFrame, key: str, vector: str, k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` rows of largest inner product for every row whose key is divisible by ``every``.

    Returns ``query_id, rank, vec_id, score``, nearest first, ties to the smaller
    key; the query's own row is no candidate. Null, zero and non-finite vectors
    and rows with a null key take no part; vectors of different sizes do not meet;
    of a repeated key one row counts. Every row is indexed; recall is measured in
    the tests. No group holds more than about ``BLOCK`` + ``QUERY_BLOCK`` vectors.
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    data = materialize(usable(rows, key, vector).withColumn("norm", norm), "ann-vectors")
    facts = data.agg(
        F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q"), F.max("norm").alias("longest")
    ).first()
    # Counted from the longest, so that equal norms share a band whatever their last bits.
    band = F.floor(F.log(F.lit(facts["longest"] or 1.0) / F.col("norm") * (1 + 1e-6)) / np.log(BAND))
    data = data.withColumn("band", band)
    bands = materialize(
        data.groupBy("size", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "ann-bands"
    )
    bands = broadcast_if_small(bands)
    query_blocks = max(1, -(-(facts["q"] or 0) // QUERY_BLOCK))
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = data.join(bands, ["size", "band"]).select(
        "vec_id", "vector", "size", "band", spread(F.col("blocks")).alias("b"), each(F.lit(query_blocks)).alias("q")
    )
    right = data.drop("band").where(F.col("vec_id") % every == 0).join(bands, "size").select(
        "vec_id", "vector", "size", "band", spread(F.lit(query_blocks)).alias("q"), each(F.col("blocks")).alias("b")
    )
    right = right.toDF(*right.columns)  # columns of its own, for both sides come from ``data`` and ``bands``

    def search(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, ...]] = []
        if len(own) and len(queries):
            ids = own["vec_id"].to_numpy()
            queries = queries.sort_values("vec_id")
            block = SortedProjections(np.stack(own["vector"].to_numpy()), np.stack(queries["vector"].to_numpy()))
            for q, query_id in enumerate(queries["vec_id"]):
                at = block.candidates(q)
                near, score = block.best(q, at[ids[at] != query_id], ids, k)
                found.append((np.full(len(near), query_id), near, score))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    by = ["size", "q", "band", "b"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
