"""Key lookups that stay even when one key holds much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import broadcast_if_small, materialize

HOT_ROWS = 1_000_000


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    spread: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` with ``table``, which holds each ``key`` at most once.

    A key with more than ``hot_rows`` rows is split over several join keys, by
    the hash of ``spread`` (a column that tells the rows apart), and its one
    table row is repeated for each part. The hot keys are counted once, stored and
    broadcast if they are few. Rows with a null key meet nothing: they are kept out
    of the join, and come back unmatched with ``how="left"``.
    """
    given = rows.where(F.col(key).isNotNull())
    counted = (
        given.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))
    )
    hot = broadcast_if_small(materialize(counted, "hot-keys"))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    split_rows = (
        given.join(hot, key, "left")
        .withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int"))
        .drop("_parts")
    )
    split_table = (
        table.join(hot, key, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    met = split_rows.join(split_table, [key, "_part"], how).drop("_part")
    if how != "left":
        return met
    return met.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row ``(key, order)`` per key with the lowest ``order``.

    An aggregate rather than a ranking window: copies are folded before the
    shuffle, so a key with a third of all rows is no hot spot.
    """
    return rows.groupBy(key).agg(F.min(order).alias(order))
