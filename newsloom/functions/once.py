"""Compute costly columns exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that no later filter can make Spark compute twice.

    A filter on a projected column is pushed below the projection together with
    the expression, which then runs in the filter and again in the projection.
    The output of a generator stays where it is; this one gives one row per row.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(made)))
