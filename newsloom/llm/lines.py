"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line keys, bucketed and sorted by key, with the number of
documents that hold the line and the largest of their ids. Each batch of documents
is folded to such a run, merge-anti-joined with the runs that are there, so that
only lines they have not settled are added, and becomes a run of the lowest level;
``fanout`` runs of a level are merged into one of the next. A last merge of the runs
gives the lines that many documents hold, and the lines of the documents are
merge-anti-joined with those.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.urlrules import LOWER, UPPER
from newsloom.operators.lookup import lookup
from newsloom.session import materialize, scratch_path

# White space that is stripped from a line.
SPACE = "\t\n\x0b\x0c\r "
#: Batches of one call of ``dedup``. They change how often runs are merged, not the result.
BATCHES = 4


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, least: int = 20) -> DataFrame:
    """``doc_id, text_hash, at, key`` of each line whose key has at least ``least`` code points.

    The key of a line is 128 bits of the line without white space at its ends and
    with A-Z lower-cased; ``at`` is its place in the text, from 0.
    """
    bare = F.transform(_lines(F.col("text")), lambda line: F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER))
    placed = F.transform(bare, lambda line, at: F.struct(at.alias("at"), line.alias("line")))
    long = F.filter(placed, lambda x: F.char_length(x["line"]) >= least)
    keyed = F.transform(long, lambda x: F.struct(x["at"].alias("at"), F.unhex(F.md5(x["line"].cast("binary"))).alias("key")))
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(keyed))


class Run(NamedTuple):
    table: DataFrame  # bucketed and sorted by key: key, docs, last
    path: str


class LineRuns:
    """The levelled runs of an index of lines; ``buckets`` is the number of files of a run."""

    def __init__(self, spark: SparkSession, documents: int = 3, fanout: int = 4, buckets: int | None = None):
        self.spark, self.documents, self.fanout = spark, documents, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: The runs of each level, the lowest level first.
        self.levels: list[list[Run]] = [[]]

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _written(self, rows: DataFrame) -> Run:
        """``rows`` as a sorted run in the shared folder; the table's name is given up once it is read."""
        name, path = f"newsloom_run_{uuid.uuid4().hex}", scratch_path(self.spark, "line-run")
        writer = rows.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key")
        writer.option("path", path).saveAsTable(name, format="parquet")
        table = self.spark.read.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return Run(table, path)

    def _merged(self, runs: list[Run]) -> DataFrame:
        """One row per key of several runs, read by their paths: a union of bucketed tables is not dealt by key."""
        rows = self.spark.read.schema(runs[0].table.schema).parquet(*[run.path for run in runs])
        return rows.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def add(self, keys: DataFrame) -> None:
        """Add a batch of ``doc_id, key``. A document's lines must all come in one batch.

        Rows without a doc_id are no document and add nothing. A line that a run
        holds for enough documents, one of them as late as the batch's, is settled:
        more documents change nothing, so it is not added again.
        """
        own = (
            keys.where("doc_id IS NOT NULL").groupBy("key")
            .agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last"))
        )
        for run in self.runs():
            settled = run.table.where(F.col("docs") >= self.documents).select("key", F.col("last").alias("settled_last"))
            own = own.join(settled, (own["key"] == settled["key"]) & (F.col("settled_last") >= F.col("last")), "left_anti")
        self.levels[0].append(self._written(own))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._written(self._merged(self.levels[level])))
            self.levels[level] = []
            level += 1

    def repeated(self) -> DataFrame:
        """``key, last`` of the lines that enough documents hold."""
        runs = self.runs()
        merged = runs[0].table if len(runs) == 1 else self._merged(runs)
        return merged.where(F.col("docs") >= self.documents).select("key", "last")


def _kept(text: Column, gone: Column) -> Column:
    """The lines of ``text`` without those at the sorted places ``gone``, in time linear in both."""
    n = F.size(_lines(text))
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(n))
    runs = F.transform(
        F.sequence(F.lit(1), F.size(edges) - 1),
        lambda i: F.slice(_lines(text), F.get(edges, i - 1) + 2, F.get(edges, i) - F.get(edges, i - 1) - 1),
    )
    return F.array_join(F.flatten(runs), "\n")


def dedup(docs: DataFrame, least: int = 20, documents: int = 3, batches: int = BATCHES) -> DataFrame:
    """Drop the lines that ``documents`` or more documents hold, but for the last of them.

    A line counts by its key (``line_keys``); lines whose key has fewer than
    ``least`` code points always stay. Each line of a repeated key goes, except in
    the document with the largest doc_id that holds it. Returns ``doc_id, n_lines,
    n_dropped, text`` of every row, ``text`` being the lines left, joined by line
    ends. A null or empty text is one empty line. Rows that share a doc_id are one
    document to the count; rows without one are none, hold no line last, and lose
    the lines that are repeated elsewhere. Repeated rows get equal results. Other
    columns are ignored, an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    keys = materialize(line_keys(rows, least).withColumn("batch", batch), "line-keys", "batch")
    index = LineRuns(docs.sparkSession, documents)
    for b in range(batches):
        index.add(keys.where(F.col("batch") == b).select("doc_id", "key"))
    repeated = materialize(index.repeated(), "line-repeated")
    found = lookup(keys.drop("batch"), repeated, "key", "doc_id").where(~F.col("last").eqNullSafe(F.col("doc_id")))
    gone = (
        found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("gone"))
        .select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "gone")
    )
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash"))
    met = rows.withColumn("text_hash", F.xxhash64("text")).join(gone, same, "left")
    return met.select(
        "doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(_kept(F.col("text"), F.col("gone"))).alias("text"),
    )


def oracle(least: int = 20, documents: int = 3) -> str:
    """DuckDB SQL for ``doc_id, n_lines, n_dropped, kept_sha256`` over ``documents``."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT i, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, {space}), '{UPPER}', '{LOWER}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {least} GROUP BY key HAVING count(DISTINCT doc_id) >= {documents}),
m AS (SELECT i, any_value(k.doc_id) AS doc_id, count(*) AS n_lines,
             count(*) FILTER (WHERE r.key IS NOT NULL AND last IS DISTINCT FROM k.doc_id) AS n_dropped,
             string_agg(line, chr(10) ORDER BY place) FILTER (WHERE r.key IS NULL OR last IS NOT DISTINCT FROM k.doc_id) AS kept
      FROM k LEFT JOIN r USING (key) GROUP BY i)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM m"""
