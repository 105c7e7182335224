"""Clean a corpus of documents and pack it: five stages, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, jaccard, packing, pii, toxicity
from newsloom.llm.workers import small_batches
from newsloom.operators.lookup import lookup
from newsloom.session import broadcast_if_small, materialize


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that the toxicity model predicts to be toxic."""
    small_batches(spark)
    own = {c: c if c == "text" else f"column_{i}" for i, c in enumerate(docs.columns)}  # no name of the corpus meets one of the model's
    scored = toxicity.score(docs.select(*[F.col(c).alias(a) for c, a in own.items()]), toxicity.train(docs, _labels(spark, sf_dir)))
    return scored.where("predicted = 0").select(*[F.col(a).alias(c) for c, a in own.items()])


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that are linked by similar shingles keep the one with the lowest doc_id.

    Each row is judged by its text: rows that repeat a doc_id are compared like all
    others, and so are rows with a null doc_id, which are kept only if no row of
    their group has one; of rows with equal doc_id and text one stays. Texts without
    words are similar to nothing and all stay.
    """
    small_batches(spark)
    rows = materialize(jaccard.classes(docs, k=5, percent=80), "stage-groups")
    texts = rows.where("component IS NOT NULL").groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")
    groups = texts.groupBy("component").agg(F.min(order).alias("first"), F.sum("rows").alias("all")).where(F.col("all") > 1)
    judged = lookup(texts, groups, "component", "text_hash")
    own, text_hash, one = (_free(docs, name) for name in ("own", "text_hash", "one"))
    listed = materialize(
        judged.withColumn("chosen", F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash") == F.col("first"))
        .where("NOT chosen OR rows > 1").select(F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash), F.col("chosen").alias(one)),
        "stage-listed",
    )
    keyed = docs.withColumn(text_hash, F.xxhash64("text"))
    some = broadcast_if_small(listed.withColumnRenamed(text_hash, f"{text_hash}_"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(text_hash) == F.col(f"{text_hash}_"))
    met = keyed.join(some, same, "left")
    alone = met.where(F.col(one).isNull()).select(*docs.columns)
    folded = met.where(F.col(one)).groupBy(own, text_hash).agg(F.first(F.struct(*docs.columns)).alias(one))
    return alone.unionByName(folded.select(f"{one}.*"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the rows that hold a benchmark item, whatever their doc_id."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    row = _free(docs, "row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "stage-leak-rows")
    found = decontaminate.leaks(rows.select(F.col(row).alias("doc_id"), "text"), benchmark)
    ids = materialize(found.select(F.col("doc_id").alias(row)).distinct(), "stage-leak-ids")
    return rows.join(broadcast_if_small(ids), row, "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind of personal data in its place; n_chars follows the text."""
    small_batches(spark)
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left into sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("PII", mask_personal_data),
    ("best-fit packing", pack),
]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
