"""Feeds, search, latest entries, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import FEED_SQL, feed, sql_text, sql_tokens, table
from newsloom.functions.topics import (
    MAX_TOPIC_LENGTH, SPECIAL_CHARACTERS, TOPIC_STOP_WORDS, normalize_topic, reject_reason,
)
from newsloom.plans.digest import fetch_content
from newsloom.schema import FEED_FIELDS
from newsloom.session import scratch_path
from newsloom.sources.feeds import (
    first_entries, latest, parse_api_responses, read_rss, search, with_defaults, with_fallback,
)

SEARCHES = ("then only", "Ones than", "rest", "the of", "here here", "no_such_word", "heat thing re")

# Each document gives topics of every kind by these rules, and each sentence of its text.
TOPICS = (
    "text",
    "rpad(lang, 101, source)",
    "rpad(lang, 100, source)",
    "concat(upper(source), ' & ', lang, ' -- News~`')",
    "concat('5g ', lang)",
    "concat(' ', lang)",
    "concat('-5g ', lang, '?!')",
    "'The of, AND!'",
    "'!!! ...'",
    "''",
    "CAST(NULL AS {text})",
    "concat(source, {tab}, lang)",
    "concat(source, {newline})",
)


def _topics(spark, sf_dir):
    rules = [r.format(text="STRING", tab="char(9)", newline="char(10)") for r in TOPICS]
    topics = F.concat(F.array(*[F.expr(r) for r in rules]), F.split("text", r"\. "))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(topics).alias("variant", "topic"))


_TOPICS_SQL = "topics AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS variant, {r.format(text='VARCHAR', tab='chr(9)', newline='chr(10)')} AS topic FROM documents"
    for i, r in enumerate(TOPICS)
) + f"""
UNION ALL SELECT doc_id, {len(TOPICS)} + unnest(range(len(s))) AS variant, unnest(s) AS topic
FROM (SELECT doc_id, string_split(text, '. ') AS s FROM documents))"""
_CLEAN = (
    f"trim(regexp_replace(translate(lower(topic), {sql_text(SPECIAL_CHARACTERS)}, "
    f"'{' ' * len(SPECIAL_CHARACTERS)}'), ' +', ' ', 'g'))"
)
_NORMAL = (
    f"array_to_string(list_filter(string_split({_CLEAN}, ' '), lambda w: w <> '' AND w NOT IN "
    f"({', '.join(sql_text(w) for w in TOPIC_STOP_WORDS)})), ' ')"
)
_REASON = rf"""
CASE WHEN topic IS NULL OR topic = '' THEN 'empty'
     WHEN length(topic) > {MAX_TOPIC_LENGTH} THEN 'too_long'
     WHEN regexp_matches(topic, '[^\x00-\x7F]') THEN 'non_ascii'
     WHEN regexp_matches(topic, '[^\x20-\x7E]') THEN 'non_printable'
     WHEN regexp_matches(topic, '^[0-9]') THEN 'starts_with_digit'
     WHEN starts_with(topic, ' ') THEN 'starts_with_space'
     WHEN {_CLEAN} = '' THEN 'empty_after_cleanup'
     WHEN {_NORMAL} = '' THEN 'only_stop_words' END"""


def topic_reject(spark, sf_dir):
    return _topics(spark, sf_dir).select(
        "doc_id", "variant", reject_reason(F.col("topic")).alias("reject_reason")
    )


def topic_clean(spark, sf_dir):
    topic = F.col("topic")
    return _topics(spark, sf_dir).where(reject_reason(topic).isNull()).select(
        "doc_id", "variant", "topic", normalize_topic(topic).alias("normalized")
    )


def api_unnest(spark, sf_dir):
    """Responses of 20 entries each, as JSON text, some fields left out or null."""
    entry = F.struct(
        F.col("pos"),
        F.when(F.col("pos") % 17 != 0, F.struct(F.col("source").alias("name"))).alias("source"),
        "author", "title", "url", "publishedAt",
    )
    page = (F.col("pos") - F.col("pos") % 20).alias("page")
    listed = F.array_sort(F.collect_list(entry))  # at most 20 entries
    payloads = feed(spark, sf_dir).groupBy(page).agg(
        F.to_json(F.struct(F.lit("ok").alias("status"), listed.alias("articles"))).alias("payload")
    )
    return parse_api_responses(payloads, "payload", "page")


API_UNNEST_SQL = f"""
WITH {FEED_SQL}
SELECT pos - pos % 20 AS page,
       row_number() OVER (PARTITION BY pos - pos % 20 ORDER BY pos) - 1 AS pos,
       coalesce(title, 'No title') AS title, coalesce(url, '#') AS url,
       CASE WHEN pos % 17 <> 0 THEN source ELSE 'Unknown' END AS source,
       coalesce(author, 'Unknown') AS author, coalesce("publishedAt", 'Unknown') AS "publishedAt"
FROM feed"""


def rss_scan(spark, sf_dir):
    """Feeds of 50 items each, written as XML and read back; 20 are read of each."""
    number = (F.col("pos") - F.col("pos") % 50).alias("feed_no")
    items = feed(spark, sf_dir).select(
        number, "pos",
        F.regexp_replace("title", r"[^\p{L}\p{N}]+", "-").alias("title"), F.col("url").alias("link"),
        F.struct(F.col("source").alias("_VALUE"), F.concat(F.lit("https://"), "source").alias("_url")).alias("source"),
        "author", F.col("publishedAt").alias("pubDate"),
    )
    path = scratch_path(spark, "rss")
    (
        items.repartitionByRange("feed_no").sortWithinPartitions("feed_no", "pos").drop("pos")
        .write.partitionBy("feed_no").format("xml")
        .option("rootTag", "channel").option("rowTag", "item").save(path)
    )
    return read_rss(spark, f"{path}/*").select(
        F.regexp_extract("feed", r"feed_no=(\d+)", 1).cast("long").alias("feed_no"), "pos", *FEED_FIELDS
    )


RSS_SCAN_SQL = rf"""
WITH {FEED_SQL}
SELECT * FROM (
  SELECT pos - pos % 50 AS feed_no, row_number() OVER (PARTITION BY pos - pos % 50 ORDER BY pos) - 1 AS pos,
         regexp_replace(title, '[^\p{{L}}\p{{N}}]+', '-', 'g') AS title, url, source,
         coalesce(author, 'Unknown') AS author, coalesce("publishedAt", 'Unknown') AS "publishedAt"
  FROM feed)
WHERE pos < 20"""


def feed_search(spark, sf_dir):
    topics = spark.createDataFrame([(t,) for t in SEARCHES], "topic string")
    return search(feed(spark, sf_dir), topics).select("topic", "rank", "pos", *FEED_FIELDS)


FEED_SEARCH_SQL = f"""
WITH {FEED_SQL},
topics AS (SELECT topic, list_distinct(string_split(lower(topic), ' ')) AS words
           FROM (VALUES {', '.join(f"({sql_text(t)})" for t in SEARCHES)}) AS t(topic))
SELECT topic, rank, pos, title, url, source, author, "publishedAt" FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY pos) AS INTEGER) AS rank
  FROM topics, (SELECT *, {sql_tokens('content')} AS tokens FROM feed WHERE lang = 'en')
  WHERE list_has_all(tokens, words))
WHERE rank <= 20"""


def feed_first(spark, sf_dir):
    return with_defaults(first_entries(feed(spark, sf_dir))).select("pos", *FEED_FIELDS)


FEED_FIRST_SQL = f"""
WITH {FEED_SQL}
SELECT pos, coalesce(title, 'No title') AS title, coalesce(url, '#') AS url,
       coalesce(source, 'Unknown') AS source, coalesce(author, 'Unknown') AS author,
       coalesce("publishedAt", 'Unknown') AS "publishedAt"
FROM feed ORDER BY pos LIMIT 20"""


def _two_feeds(spark, sf_dir):
    """Long articles as the first feed, all articles as the second; a topic is a
    source and a language, and not every topic has long articles."""
    rows = feed(spark, sf_dir).withColumn("topic", F.concat("source", F.lit("/"), "lang"))
    columns = ["topic", "pos", *FEED_FIELDS]
    first = rows.where(F.length("content") > 9000).select(*columns, F.lit("first").alias("feed"))
    return first, rows.select(*columns, F.lit("second").alias("feed"))


_TWO_FEEDS_SQL = f"""
WITH {FEED_SQL},
pool AS (SELECT source || '/' || lang AS topic, pos, title, url, source, author, "publishedAt", content FROM feed),
a AS (SELECT * EXCLUDE (content), 'first' AS feed FROM pool WHERE length(content) > 9000),
b AS (SELECT * EXCLUDE (content), 'second' AS feed FROM pool),
fetched AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE topic NOT IN (SELECT topic FROM a))"""


def feed_fallback(spark, sf_dir):
    return with_fallback(*_two_feeds(spark, sf_dir))


def feed_fetch_content(spark, sf_dir):
    return fetch_content(*_two_feeds(spark, sf_dir))


def feed_latest(spark, sf_dir):
    return latest(feed(spark, sf_dir)).select("pos", *FEED_FIELDS)


def feed_latest_by_time(spark, sf_dir):
    return latest(feed(spark, sf_dir), by_time=True).select("pos", *FEED_FIELDS)


_LATEST = "coalesce(\"publishedAt\", 'Unknown') DESC, pos"

QUERIES = {
    "topic_reject": topic_reject,
    "topic_clean": topic_clean,
    "api_unnest": api_unnest,
    "rss_scan": rss_scan,
    "feed_search": feed_search,
    "feed_first": feed_first,
    "feed_fallback": feed_fallback,
    "feed_latest": feed_latest,
    "feed_latest_by_time": feed_latest_by_time,
    "fetch_content": feed_fetch_content,
}

ORACLE = {
    "topic_reject": f"WITH {_TOPICS_SQL} SELECT doc_id, variant, {_REASON} AS reject_reason FROM topics",
    "topic_clean": f"WITH {_TOPICS_SQL} SELECT doc_id, variant, topic, {_NORMAL} AS normalized FROM topics WHERE {_REASON} IS NULL",
    "api_unnest": API_UNNEST_SQL,
    "rss_scan": RSS_SCAN_SQL,
    "feed_search": FEED_SEARCH_SQL,
    "feed_first": FEED_FIRST_SQL,
    "feed_fallback": f"{_TWO_FEEDS_SQL} SELECT * FROM fetched",
    "feed_latest": f'WITH {FEED_SQL} SELECT pos, title, url, source, author, "publishedAt" FROM feed ORDER BY {_LATEST} LIMIT 10',
    "feed_latest_by_time": f"""
WITH {FEED_SQL} SELECT pos, title, url, source, author, "publishedAt" FROM feed
ORDER BY TRY_CAST("publishedAt" AS TIMESTAMP) DESC NULLS LAST, pos LIMIT 10""",
    "fetch_content": f"""{_TWO_FEEDS_SQL}
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY {_LATEST}) AS INTEGER) AS rank FROM fetched)
WHERE rank <= 10""",
}
