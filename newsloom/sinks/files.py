"""CSV and JSON Lines output."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import capitalize
from newsloom.functions.topics import topic_slug

# Quotes are doubled, and text with line breaks or quotes is quoted, as CSV
# readers expect. Blanks at the ends of a text stay.
CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(multiLine=True, **CSV_OPTIONS).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; null fields are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def create_table(spark: SparkSession, records: Iterable, schema: T.StructType) -> DataFrame:
    """A table of a few records that the driver has; ``records_table`` takes landed ones."""
    return spark.createDataFrame(list(records), schema)


def records_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table of landed records, one JSON object a line: a column for every key that any record has.

    A key that a record lacks is null. ``schema`` names the columns instead, and saves
    the pass that finds the keys; a line that is no object is left out.
    """
    if schema is not None:
        kept = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
        rows = spark.read.schema(kept).option("columnNameOfCorruptRecord", "_bad").json(path)
        return rows.where(F.col("_bad").isNull()).drop("_bad")
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def save_digest(df: DataFrame, folder: str, topic: str | None) -> str | None:
    """Write the digest under a name made from the topic; nothing if it is empty.

    The file has all articles, with capitalised sentiment and without row ids.
    """
    if df.isEmpty():
        return None
    if "sentiment" in df.columns:
        df = df.withColumn("sentiment", capitalize(F.col("sentiment")))
    df = df.drop("id")
    path = f"{folder.rstrip('/')}/{topic_slug(topic)}_clustered_articles"
    write_csv(df, path)
    return path
