"""News feeds: landed API responses, landed RSS items, search over a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.once import with_once
from newsloom.functions.text import tokens, words
from newsloom.operators.topk import top_k_per_group
from newsloom.schema import API_RESPONSE, FEED_FIELDS, RSS_ITEM
from newsloom.session import MAX_BROADCAST, fits_in_broadcast

PAGE_SIZE = 20  # fixed value: entries asked of a feed
LATEST = 10  # fixed value: entries used in a digest

# What stands for a missing field.
API_DEFAULTS = {
    "title": "No title", "url": "#", "source": "Unknown", "author": "Unknown",
    "publishedAt": "Unknown",
}


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing feed fields become their default text, row by row."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(d)) for c, d in API_DEFAULTS.items()}
    )


def unnest_articles(responses: DataFrame, *keys: str) -> DataFrame:
    """One row per article of each response, in response order."""
    entries = responses.select(*keys, F.posexplode("articles").alias("pos", "a"))
    a = F.col("a")
    flat = entries.select(
        *keys,
        F.col("pos").cast("long").alias("pos"),
        a["title"].alias("title"),
        a["url"].alias("url"),
        a["source"]["name"].alias("source"),
        a["author"].alias("author"),
        a["publishedAt"].alias("publishedAt"),
    )
    return with_defaults(flat)


def read_api_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed API responses, one JSON document per file.

    ``response`` is the file and ``pos`` the place in it; a digest of several
    files takes ``numbered(rows, "response", "pos")``.
    """
    landed = spark.read.schema(API_RESPONSE).option("multiLine", True).json(path)
    return unnest_articles(landed.select(F.col("_metadata.file_path").alias("response"), "articles"), "response")


def parse_api_responses(payloads: DataFrame, payload: str, *keys: str) -> DataFrame:
    """Like :func:`read_api_responses`, for responses held as text in a column."""
    parsed = payloads.select(*keys, F.from_json(payload, API_RESPONSE).alias("_r"))
    return unnest_articles(parsed.select(*keys, F.col("_r.articles").alias("articles")), *keys)


def rss_fields(items: DataFrame, *keys: str) -> DataFrame:
    renamed = items.select(
        *keys,
        F.col("title"),
        F.col("link").alias("url"),
        F.col("source._VALUE").alias("source"),
        F.col("author"),
        F.col("pubDate").alias("publishedAt"),
    )
    unknown = {c: F.coalesce(F.col(c), F.lit("Unknown")) for c in ("source", "author", "publishedAt")}
    return renamed.withColumns(unknown)


def read_rss(spark: SparkSession, path: str, limit: int = PAGE_SIZE) -> DataFrame:
    """The first ``limit`` items of each landed RSS file, in file order.

    One file is one feed. Items of a file keep their order through the start of
    their part of the file and the row counter of the scan, which grows along it.
    A digest of several files takes ``numbered(rows, "feed", "pos")``.
    """
    items = (
        spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)
        .select(
            "*", F.col("_metadata.file_path").alias("feed"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
        .withColumn("_at", F.monotonically_increasing_id())
    )
    ranked = top_k_per_group(rss_fields(items, "feed", "_block", "_at"), ["feed"], [F.col("_block"), F.col("_at")], limit)
    return ranked.select("feed", (F.col("rank") - 1).cast("long").alias("pos"), *FEED_FIELDS)


def search(
    articles: DataFrame,
    topics: DataFrame,
    text: str = "content",
    lang: str = "lang",
    order: Column | None = None,
    limit: int = PAGE_SIZE,
) -> DataFrame:
    """For each topic the first ``limit`` English articles with all its words.

    ``topics`` has ``topic``. Articles are read once for all topics: their
    distinct words meet the topic words in one join, which leaves few rows.
    """
    wanted = (
        topics.select("topic").distinct()
        .withColumn("_words", F.array_distinct(words(F.lower("topic"))))
        .where(F.size("_words") > 0)
        .select("topic", F.size("_words").alias("_n"), F.explode("_words").alias("_word"))
    )
    few = fits_in_broadcast(wanted, MAX_BROADCAST // limit)  # then the found rows are few too
    small = F.broadcast if few else lambda df: df
    order = F.col("pos") if order is None else order
    english = with_once(
        articles.where(F.col(lang) == "en"), _own=F.array_distinct(tokens(F.col(text)))
    )
    hits = (
        english.select("pos", order.alias("_order"), F.explode("_own").alias("_word"))
        .join(small(wanted), "_word")
        .groupBy("topic", "_n", "pos", "_order")
        .agg(F.count(F.lit(1)).alias("_hits"))
        .where(F.col("_hits") == F.col("_n"))
    )
    best = top_k_per_group(hits, ["topic"], [F.col("_order"), F.col("pos")], limit)
    found = best.select("topic", "pos", "rank")
    return articles.join(small(found), "pos").select(
        "topic", "rank", *articles.columns
    )


def first_entries(feed: DataFrame, limit: int = PAGE_SIZE) -> DataFrame:
    return feed.orderBy("pos").limit(limit)


def published_time(published: Column) -> Column:
    """ISO or RFC 822 text as a timestamp, null if neither."""
    rfc = F.regexp_replace(published, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(published),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")),
    )


def latest_order(by_time: bool = False) -> list[Column]:
    """Newest first, by the text of the date as it stands; ties keep feed order."""
    published = F.coalesce(F.col("publishedAt"), F.lit("Unknown"))
    if by_time:
        return [published_time(published).desc_nulls_last(), F.col("pos").asc()]
    return [published.desc(), F.col("pos").asc()]


def latest(feed: DataFrame, limit: int = LATEST, by_time: bool = False) -> DataFrame:
    return feed.orderBy(*latest_order(by_time)).limit(limit)


def latest_per_topic(feed: DataFrame, limit: int = LATEST, by_time: bool = False) -> DataFrame:
    return top_k_per_group(feed, ["topic"], latest_order(by_time), limit)


def with_fallback(
    first: DataFrame, second: DataFrame, covered: DataFrame | None = None
) -> DataFrame:
    """Rows of ``first``, and rows of ``second`` for topics that ``first`` lacks.

    ``covered`` names the topics of ``first`` where that is cheaper than reading
    them from it.
    """
    covered = (first if covered is None else covered).select("topic").distinct()
    return first.unionByName(second.join(covered, "topic", "left_anti"))
