"""Drop topics that are close to an earlier kept topic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.once import with_once
from newsloom.functions.vectors import norm
from newsloom.operators.embed import embed
from newsloom.session import broadcast_if_small, materialize, scratch_path

THRESHOLD = 0.75  # fixed value
#: Rows that are settled at a time; a digest with more is settled in rounds.
BLOCK = 1_024


def _keep_in_order(units: np.ndarray, threshold: float) -> list[int]:
    kept: list[int] = []
    cosines = units @ units.T
    for i in range(len(units)):
        if not kept or cosines[i, kept].max() < threshold:
            kept.append(i)
    return kept


def _apart(rows: DataFrame, kept: np.ndarray, threshold: float) -> DataFrame:
    """The rows whose cosine with every one of ``kept`` is below ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, kept.shape[1])
            yield batch.filter(pa.array((unit @ kept.T).max(axis=1) < threshold)) if batch.num_rows else batch

    return rows.select("pos", "unit").mapInArrow(run, rows.select("pos", "unit").schema)


def _settle_in_rounds(rows: DataFrame, threshold: float, path: str) -> None:
    """Write the ``pos`` of the rows of one digest that stay, ``BLOCK`` or fewer in a round.

    The first rows that are left are settled by themselves, as all kept before have met
    them; what is close to those kept then leaves the rest. So no pairs are made, a
    round moves no rows, and copies of a kept row are gone after it.
    """
    while True:
        first = rows.orderBy("pos").limit(BLOCK).collect()
        if not first:
            return
        units = np.asarray([r["unit"] for r in first], float)
        places = _keep_in_order(units, threshold)
        kept = rows.sparkSession.createDataFrame([(first[i]["pos"],) for i in places], rows.select("pos").schema)
        kept.write.mode("append").parquet(path)
        if len(first) < BLOCK:
            return
        rows = materialize(_apart(rows.where(F.col("pos") > first[-1]["pos"]), units[places], threshold), "similar-rest")


def filter_similar(
    topics: DataFrame, vec: str = "vec", threshold: float = THRESHOLD, digest: str = "digest"
) -> DataFrame:
    """Rows of ``topics`` that stay in their ``digest``: in order of ``pos``, a row is
    kept if its cosine with every row kept before is below ``threshold``.

    ``pos`` is unique in its digest. Digests of up to ``BLOCK`` topics are settled each
    in a task, many side by side; larger ones in rounds over all partitions.
    """
    vectors = topics.select(digest, "pos", F.col(vec).cast("array<double>").alias("_v"))
    length = F.col("_length")  # made once a row, not once a component
    units = with_once(vectors, _length=norm(F.col("_v"))).select(
        digest, "pos",
        F.when(length == 0, F.col("_v")).otherwise(F.transform("_v", lambda x: x / length)).alias("unit"),
    )
    units = materialize(units, "similar-units")
    large = units.groupBy(digest).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(digest)
    large = materialize(large, "similar-large")

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        return rows.iloc[_keep_in_order(np.stack(rows["unit"].to_numpy()), threshold)][[digest, "pos"]]

    small = units.join(broadcast_if_small(large), digest, "left_anti")
    kept = small.groupBy(digest).applyInPandas(settle, topics.select(digest, "pos").schema)
    for row in large.toLocalIterator():  # each has more than BLOCK rows
        path = scratch_path(topics.sparkSession, "similar-kept")
        own = units.where(F.col(digest).eqNullSafe(F.lit(row[digest])))
        _settle_in_rounds(own.select("pos", "unit"), threshold, path)
        found = topics.sparkSession.read.schema(topics.select("pos").schema).parquet(path)
        kept = kept.unionByName(found.select(F.lit(row[digest]).cast(topics.schema[digest].dataType).alias(digest), "pos"))
    return topics.join(kept, [digest, "pos"], "left_semi")


def filter_similar_topics(
    topics: DataFrame,
    keywords: str = "keywords",
    threshold: float = THRESHOLD,
    digest: str = "digest",
    embedder: Callable[[DataFrame, str], DataFrame] = embed,
) -> DataFrame:
    """:func:`filter_similar` for topics ``(digest, pos, keywords array<string>)``;
    ``pos`` is unique over all digests.

    Each list is embedded as one text, its keywords joined by ", ".
    """
    if topics.isEmpty():
        return topics
    sentences = topics.select(digest, "pos", F.array_join(keywords, ", ").alias("_sentence"))
    vectors = embedder(sentences, "_sentence").where("pos IS NOT NULL").select(
        digest, "pos", vector_to_array("features").alias("vec")
    )
    kept = filter_similar(vectors, "vec", threshold, digest).select("pos")
    return topics.join(kept, "pos", "left_semi")
