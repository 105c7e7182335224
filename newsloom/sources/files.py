"""Uploaded text files and pasted URL lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import is_blank, strip
from newsloom.session import materialize


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``.txt`` file with its whole text; blank files are dropped.

    ``numbered(rows, "file")`` adds the place that a digest wants.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    return files.select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")
    ).where(~is_blank(F.col("content")))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with a unique ``pos`` that follows ``order``, such as a file and a place in it.

    A range sort deals the rows; ``pos`` has the partition above and the place in
    it below. The rows are written, so that every reader sees the same numbers.
    """
    return materialize(rows.orderBy(*order).withColumn("pos", F.monotonically_increasing_id()), "numbered")


def url_list(df: DataFrame, urls: str | Column, *keys: str) -> DataFrame:
    """One row per non-blank line, trimmed, with its line number."""
    text = F.col(urls) if isinstance(urls, str) else urls
    return (
        df.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "_line"))
        .select(*keys, F.col("pos").cast("long").alias("pos"), strip(F.col("_line")).alias("url"))
        .where(F.length("url") > 0)
    )
