"""Session helpers: settings, the shared folder, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST = 50_000  # rows
MAX_BROADCAST_BYTES = 32 << 20

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session with the setting unset gets a folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="newsloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/newsloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts the lineage,
    survives lost executors, and keeps column pruning for the next reader."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan over all cores if its files give too few partitions.

    For the per-row work on text and pages. A large table has more partitions
    than the cluster has cores and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def fits_in_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True if ``df`` has at most ``max_rows`` rows and about ``max_bytes`` bytes.

    ``take`` stops after the first ``max_rows + 1`` rows, so a large table is
    refused without being read whole.
    """
    if len(df.select(F.lit(1)).take(max_rows + 1)) > max_rows:
        return False
    row_bytes = F.lit(8 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            row_bytes = row_bytes + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            row_bytes = row_bytes + 16 * F.coalesce(F.size(F.col(field.name)), F.lit(0))
    total = df.agg(F.sum(row_bytes).alias("bytes")).first()["bytes"]
    return (total or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint behind a size check; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if fits_in_broadcast(df, max_rows, max_bytes) else df
