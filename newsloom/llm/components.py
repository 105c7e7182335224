"""Connected components as a few Spark joins (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import materialize


def _lowest(links: DataFrame) -> DataFrame:
    """(u, m): the lowest id among ``u`` and its neighbours ``v``; copies fold before the shuffle."""
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_lowest(both), "u").where("v > u and v != m")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = _lowest(down)
    moved = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every id that ``edges`` (a, b) links to a lower one.

    ``component`` is the lowest id that can be reached. Loops and repeated edges
    count for nothing; an empty table gives no rows. Each round is a written
    table; their number grows with the logarithm of the longest path.
    """
    current = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct()
    before = None
    while True:
        current = materialize(_small_star(_large_star(current)), "components")
        now = _state(current)
        if now == before or not now[0]:
            return current.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
