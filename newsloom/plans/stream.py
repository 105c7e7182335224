"""Harvest over landed URL lists as they come: each URL once, over all runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions.urls import is_acceptable_url
from newsloom.plans.harvest import distinct_urls

LANDED = "pos long, url string"
_SEEN = "url string, pos long, batch long"


def seen_urls(spark: SparkSession, folder: str) -> DataFrame:
    """``url, pos, batch`` of all URLs harvested so far; ``folder`` has one part per batch."""
    return spark.read.schema(_SEEN).option("basePath", folder).parquet(folder)


def harvest_stream(spark: SparkSession, landing: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Start harvesting the Parquet files (pos, url) that land in ``landing``, and stop when all are read.

    ``folder`` keeps what was harvested, a part per batch, and is the state of the
    stream: a batch drops what is not acceptable, folds repeats to the lowest place, and
    anti-joins the parts of earlier batches. It overwrites its own part, so a batch
    that is repeated after a failure leaves the same rows. ``checkpoint`` remembers the
    files read; the two belong together.
    """

    def add(rows: DataFrame, batch: int) -> None:
        new = distinct_urls(rows.where(is_acceptable_url(F.col("url"))))
        if batch:
            before = seen_urls(rows.sparkSession, folder).where(F.col("batch") < batch).select("url")
            new = new.join(before, "url", "left_anti")
        new.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    landed = spark.readStream.schema(LANDED).parquet(landing)
    return landed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
