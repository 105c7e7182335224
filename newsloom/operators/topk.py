"""The first k rows of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Above this k Spark ranks whole groups after the shuffle instead of cutting
# them before it (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def top_k_per_group(
    df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank",
    spread: list[str] | None = None, splits: int = 64,
) -> DataFrame:
    """Rows ranked 1..k within each group by ``order``.

    For small k Spark keeps only k rows per group and task before the shuffle.
    For large k the group is first cut in ``splits`` parts by the hash of
    ``spread``, each part keeps its own k rows, and only those are ranked.
    """
    if k > GROUP_LIMIT and spread:
        part = F.pmod(F.xxhash64(*spread), F.lit(splits))
        within = Window.partitionBy(*group, "_split").orderBy(*order)
        df = (
            df.withColumn("_split", part)
            .withColumn("_r", F.row_number().over(within))
            .where(F.col("_r") <= k)
            .drop("_r", "_split")
        )
    overall = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(overall)).where(F.col(rank) <= k)
