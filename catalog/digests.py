"""Enriched rows, files, views and whole digests."""

from __future__ import annotations

from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.clusters import (
    GLOBAL_SLOTS_SQL, RANKED_TOPICS_SQL, TOPIC_NUMBER_SQL, clustered_sql, topics_sql,
)
from catalog.common import (
    LEXICON, PAGE_FEED_SQL, PAGE_URLS_SQL, feed, page_feed, page_text_sql, page_urls,
    sentiment_sql, sql_strip, summary_sql, table,
)
from newsloom.functions.sentiment import with_sentiment
from newsloom.models import embed_with, score_with, summarize_with
from newsloom.plans import digest as D
from newsloom.plans.enrich import enrich_feed, enrich_files, enrich_urls, union_paths
from newsloom.plans.view import cluster_counts, cluster_markdown, cluster_view
from newsloom.schema import DIGEST, DIGEST_FIELDS, FEED
from newsloom.session import scratch_path
from newsloom.sinks.files import read_csv, records_table, save_digest, write_csv, write_json
from newsloom.sources.feeds import latest, read_api_responses
from newsloom.sources.files import numbered, read_text_files

SCORER = partial(with_sentiment, lexicon=LEXICON)
ROW = ["path_ord", "pos", *DIGEST_FIELDS]


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"), F.col("text").alias("content")
    )


def feed_rows(spark, sf_dir):
    return enrich_feed(page_feed(spark, sf_dir), _pages(spark, sf_dir), scorer=SCORER)


def file_rows(spark, sf_dir):
    return enrich_files(_files(spark, sf_dir), scorer=SCORER)


def url_rows(spark, sf_dir):
    return enrich_urls(page_urls(spark, sf_dir), _pages(spark, sf_dir), scorer=SCORER)


def all_rows(spark, sf_dir):
    return union_paths(feed_rows(spark, sf_dir), file_rows(spark, sf_dir), url_rows(spark, sf_dir))


_PAGE_MODELS_SQL = f"""
{page_text_sql('article')},
page_content AS (SELECT page_id AS id, text AS content FROM page_text),
{summary_sql('page_content', 'page_summary')},
{sentiment_sql('page_summary', LEXICON, 'page_score')},
enriched AS (
  SELECT url, title AS page_title, text AS content, summary, sentiment, score
  FROM page_text JOIN page_summary ON page_summary.id = page_id JOIN page_score ON page_score.id = page_id)"""

_FEED_ROWS_SQL = f"""
{PAGE_FEED_SQL},
feed_rows AS (
  SELECT 0 AS path_ord, pos, title, url, source, coalesce(author, 'Unknown') AS author, "publishedAt",
         content, summary, sentiment, score
  FROM page_feed JOIN enriched USING (url))"""

_FILE_ROWS_SQL = f"""
file_content AS (SELECT doc_id AS id, text AS content FROM documents WHERE length({sql_strip('text')}) > 0),
{summary_sql('file_content', 'file_summary')},
{sentiment_sql('file_summary', LEXICON, 'file_score')},
file_rows AS (
  SELECT 1 AS path_ord, id AS pos, 'Custom File' AS title, 'N/A' AS url, 'Uploaded File' AS source,
         'Unknown' AS author, 'Unknown' AS "publishedAt", content, summary, sentiment, score
  FROM file_content JOIN file_summary USING (id) JOIN file_score USING (id))"""

_URL_ROWS_SQL = f"""
{PAGE_URLS_SQL},
url_rows AS (
  SELECT 2 AS path_ord, pos, CASE WHEN page_title <> '' THEN page_title ELSE 'Untitled Article' END AS title, url,
         'External Link' AS source, 'Unknown' AS author, 'Unknown' AS "publishedAt",
         content, summary, sentiment, score
  FROM page_urls JOIN enriched USING (url))"""


# ---------------------------------------------------------------- view

SHOWN = ["Positive", "Negative"]


def _labelled(spark, sf_dir):
    """Documents as labelled articles: the source stands for the cluster label."""
    scored = with_sentiment(feed(spark, sf_dir), "content", lexicon=LEXICON)
    return scored.select(
        F.col("pos").alias("id"), "title", "url", "source", F.col("content").alias("summary"),
        "sentiment", F.col("source").alias("cluster_label"),
    )


def _label_topics(spark, sf_dir):
    """Topics for the sources that have a document labelled toxic; others have none."""
    toxic = table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")
    langs = (
        table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi")
        .groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))  # four languages
    )
    return langs.select(
        F.substring("source", 4, 9).cast("int").alias("cluster_id"),
        F.col("source").alias("cluster_label"),
        F.get("langs", F.lit(0)).alias("primary_focus"),
        F.slice("langs", F.lit(2), F.size("langs")).alias("related_topics"),
    )


_VIEW_SQL = f"""
scored_in AS (SELECT doc_id AS id, text AS summary FROM documents),
{sentiment_sql('scored_in', LEXICON)},
labelled AS (
  SELECT doc_id AS id, source || ' ' || lang || ' ' || doc_id AS title,
         'https://' || source || '.example.org/' || lang || '/' || doc_id AS url, source,
         text AS summary,
         upper(substring(sentiment, 1, 1)) || lower(substring(sentiment, 2)) AS sentiment, source AS cluster_label
  FROM documents JOIN scored ON id = doc_id),
shown AS (SELECT * FROM labelled WHERE sentiment IN ('Positive', 'Negative')),
counts AS (SELECT cluster_label, count(*) AS article_count FROM shown GROUP BY cluster_label),
langs AS (
  SELECT source AS cluster_label, list_sort(list(DISTINCT lang)) AS l
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source),
view AS (
  SELECT cluster_label, l[1] AS primary_focus, array_to_string(l[2:], ', ') AS related_topics, article_count
  FROM (SELECT * FROM counts ORDER BY cluster_label LIMIT 5) LEFT JOIN langs USING (cluster_label))"""


def view_counts(spark, sf_dir):
    return cluster_counts(_labelled(spark, sf_dir), SHOWN)


def view_clusters(spark, sf_dir):
    view = cluster_view(_labelled(spark, sf_dir), _label_topics(spark, sf_dir), SHOWN)
    return view.withColumn("related_topics", F.array_join("related_topics", ", "))


def view_markdown(spark, sf_dir):
    return cluster_markdown(_labelled(spark, sf_dir), _label_topics(spark, sf_dir), SHOWN)


MARKDOWN_SQL = f"""
WITH {_VIEW_SQL}
SELECT cluster_label, CAST(NULL AS BIGINT) AS id,
       '### 🧩 Cluster ' || cluster_label || chr(10)
       || CASE WHEN primary_focus IS NULL THEN '' ELSE '**Primary Topic:** ' || primary_focus || chr(10) || chr(10) END
       || CASE WHEN coalesce(related_topics, '') = '' THEN '' ELSE '**Related Topics:** ' || related_topics || chr(10) || chr(10) END
       || '**Articles:** ' || article_count || chr(10) || chr(10) AS markdown
FROM view
UNION ALL
SELECT cluster_label, id,
       '#### 📰 ' || title || chr(10) || '- **Source:** ' || source || chr(10) || '- **Sentiment:** ' || sentiment || chr(10)
       || '<details><summary><strong>Summary</strong></summary>' || chr(10) || summary || chr(10)
       || '</details>' || chr(10) || '- [Read Full Article](' || url || ')' || chr(10) || chr(10) AS markdown
FROM shown WHERE cluster_label IN (SELECT cluster_label FROM view)"""


# ---------------------------------------------------------------- files

def _records(spark, sf_dir):
    """Rows with quotes, commas, line breaks, blanks and nulls, and the whole text."""
    quoted = F.concat(F.lit('"'), F.col("title"), F.lit('", \\n'))
    return feed(spark, sf_dir).select(
        "pos", quoted.alias("title"), "url", "source", "author", "publishedAt", "content"
    )


RECORDS_SQL = """
SELECT doc_id AS pos, '"' || source || ' ' || lang || ' ' || doc_id || '", \\n' AS title,
       'https://' || source || '.example.org/' || lang || '/' || doc_id AS url, source,
       CASE WHEN doc_id % 7 <> 0 THEN 'author' || (doc_id % 13) END AS author,
       CASE WHEN doc_id % 11 <> 0
            THEN CAST(DATE '2024-01-01' + CAST(doc_id % 97 AS INTEGER) AS VARCHAR) END AS "publishedAt",
       text AS content
FROM documents"""

RECORD = T.StructType([*FEED.fields, T.StructField("content", T.StringType())])


def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_csv(_records(spark, sf_dir), path)
    return read_csv(spark, path, RECORD)


def json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "json")
    write_json(_records(spark, sf_dir), path)
    return spark.read.schema(RECORD).json(path)


def landed_records(spark, sf_dir):
    """Records landed as JSON Lines without their null fields, and a table of every key."""
    path = scratch_path(spark, "records")
    _records(spark, sf_dir).write.option("ignoreNullFields", True).json(path)
    return records_table(spark, path).select(*RECORD.names)


def digest_csv(spark, sf_dir):
    """Every document as a digest row, saved under a topic and read back whole."""
    label = F.concat(F.lit("label "), F.col("pos") % 7).alias("cluster_label")
    rows = file_rows(spark, sf_dir).select(F.col("pos").alias("id"), *DIGEST_FIELDS, label)
    path = save_digest(rows, scratch_path(spark, "digest"), "All files")
    return read_csv(spark, path, T.StructType([*DIGEST.fields, T.StructField("cluster_label", T.StringType())]))


DIGEST_CSV_SQL = f"""
WITH {_FILE_ROWS_SQL}
SELECT title, url, source, author, "publishedAt", content, summary,
       upper(substring(sentiment, 1, 1)) || lower(substring(sentiment, 2)) AS sentiment, score,
       'label ' || (pos % 7) AS cluster_label
FROM file_rows"""


FILE_SIZE = 50  # documents per text file


def _landed_texts(spark, sf_dir):
    """The folder of text files of 50 documents each, written by Spark."""
    number = (F.col("pos") - F.col("pos") % FILE_SIZE).alias("file_no")
    path = scratch_path(spark, "texts")
    (
        _files(spark, sf_dir).select(number, "pos", "content")
        .repartitionByRange("file_no").sortWithinPartitions("file_no", "pos").drop("pos")
        .write.partitionBy("file_no").text(path)
    )
    return f"{path}/*"


def text_files(spark, sf_dir):
    """Landed text files, read back whole."""
    number = F.regexp_extract("file", r"file_no=(\d+)", 1).cast("long").alias("file_no")
    return read_text_files(spark, _landed_texts(spark, sf_dir)).select(number, "content")


TEXT_FILES_SQL = f"""
SELECT file_no, content FROM (
  SELECT doc_id - doc_id % {FILE_SIZE} AS file_no, string_agg(text || chr(10), '' ORDER BY doc_id) AS content
  FROM documents GROUP BY ALL)
WHERE length({sql_strip('content')}) > 0"""


PAGE_SIZE = 20  # entries per API response


def _landed_responses(spark, sf_dir):
    """The folder of API responses, a JSON document per file."""
    page = (F.col("pos") - F.col("pos") % PAGE_SIZE).alias("page")
    article = F.struct("pos", F.struct(F.col("source").alias("name")).alias("source"), "author", "title", "url", "publishedAt")
    listed = F.array_sort(F.collect_list(article)).alias("articles")  # at most PAGE_SIZE
    path = scratch_path(spark, "responses")
    (
        page_feed(spark, sf_dir).groupBy(page).agg(listed)
        .select("page", F.to_json(F.struct(F.lit("ok").alias("status"), "articles")).alias("value"))
        .write.partitionBy("page").text(path)
    )
    return f"{path}/*"


def landed_rows(spark, sf_dir):
    """Files on disk to digest rows with ids: API responses and text files are read, numbered, enriched."""
    entries = numbered(read_api_responses(spark, _landed_responses(spark, sf_dir)), "response", "pos")
    texts = numbered(read_text_files(spark, _landed_texts(spark, sf_dir)), "file")
    rows = D.with_row_id(union_paths(
        enrich_feed(entries, _pages(spark, sf_dir), scorer=SCORER), enrich_files(texts, scorer=SCORER),
    ))
    return rows.select(*DIGEST_FIELDS, F.count(F.lit(1)).over(Window.partitionBy("id")).alias("rows_of_id"))


_FIELDS = ", ".join(f'"{c}"' for c in DIGEST_FIELDS)
LANDED_SQL = f"""
WITH {_PAGE_MODELS_SQL}, {_FEED_ROWS_SQL},
text_content AS (SELECT file_no AS id, content FROM ({TEXT_FILES_SQL})),
{summary_sql('text_content', 'text_summary')},
{sentiment_sql('text_summary', LEXICON, 'text_score')}
SELECT {_FIELDS}, 1 AS rows_of_id FROM feed_rows
UNION ALL
SELECT 'Custom File', 'N/A', 'Uploaded File', 'Unknown', 'Unknown', content, summary, sentiment, score, 1
FROM text_content JOIN text_summary USING (id) JOIN text_score USING (id)"""


# ---------------------------------------------------------------- model slots

def _joined(texts):
    return [text.replace(" ", "_") for text in texts]


def _by_length(texts):
    return [("POSITIVE", 0.75) if len(text) > 1000 else ("NEGATIVE", 0.5) for text in texts]


def _two_numbers(texts):
    return [(len(text), text.count(" ")) for text in texts]


def _slot(model):
    """A stand-in for loading a model, which happens once per Python worker."""
    return lambda: model


def model_summary(spark, sf_dir):
    rows = summarize_with(_files(spark, sf_dir), _slot(_joined))
    return rows.select("pos", "summary", "error")


def model_sentiment(spark, sf_dir):
    rows = score_with(_files(spark, sf_dir), _slot(_by_length), text="content")
    return rows.select("pos", "sentiment", "score", "error")


def model_vectors(spark, sf_dir):
    vectors = vector_to_array(F.col("features"))
    rows = embed_with(_files(spark, sf_dir), _slot(_two_numbers))
    return rows.select("pos", vectors[0].alias("characters"), vectors[1].alias("spaces"))


_BLANK = f"length({sql_strip('text')}) = 0"
_NO_INPUT = "'No input provided.'"
MODEL_SQL = {
    "model_summary": f"SELECT doc_id AS pos, CASE WHEN {_BLANK} THEN {_NO_INPUT} ELSE replace(text, ' ', '_') END AS summary, CAST(NULL AS VARCHAR) AS error FROM documents",
    "model_sentiment": f"""
SELECT doc_id AS pos, CASE WHEN {_BLANK} THEN {_NO_INPUT} WHEN length(text) > 1000 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment,
       CAST(CASE WHEN {_BLANK} THEN 0 WHEN length(text) > 1000 THEN 0.75 ELSE 0.5 END AS DOUBLE) AS score,
       CAST(NULL AS VARCHAR) AS error
FROM documents""",
    "model_vectors": "SELECT doc_id AS pos, CAST(length(text) AS DOUBLE) AS characters, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces FROM documents",
}


# ---------------------------------------------------------------- digests

OUTPUT = [*DIGEST_FIELDS, "cluster_id", "cluster_label"]


def _as_text(topics):
    related = F.array_join("related_topics", " | ").alias("related_topics")
    return topics.select("cluster_id", "cluster_label", "primary_focus", related)


def label_all(spark, sf_dir):
    """Cluster and label every document."""
    articles = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content")
    )
    return D.cluster_and_label(articles).articles.select("id", "cluster_id", "cluster_label")


def topics_of_all(spark, sf_dir):
    """Label, main topic and related topics of the clusters of all documents."""
    articles = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content")
    )
    return D.cluster_and_label(articles).topics.transform(_as_text)


def _digest(spark, sf_dir):
    """Latest feed entries, every document as a file, and every page as a URL."""
    pages = _pages(spark, sf_dir)
    return D.digest(
        feed=latest(page_feed(spark, sf_dir)),
        files=_files(spark, sf_dir),
        urls=pages.select(F.col("page_id").alias("pos"), "url"),
        pages=pages,
        scorer=SCORER,
    )


def whole_digest(spark, sf_dir):
    return _digest(spark, sf_dir).articles.select(*OUTPUT)


def digest_articles(spark, sf_dir):
    """The articles of the whole digest without their clusters."""
    return whole_digest(spark, sf_dir).select(*DIGEST_FIELDS)


def digest_topics(spark, sf_dir):
    return _digest(spark, sf_dir).topics.transform(_as_text)


def headline_articles(spark, sf_dir):
    return latest_headlines(spark, sf_dir).select(*DIGEST_FIELDS)


def latest_headlines(spark, sf_dir):
    result = D.latest_headlines(page_feed(spark, sf_dir), _pages(spark, sf_dir), scorer=SCORER)
    return result.articles.select(*OUTPUT)


_LATEST_ROWS_SQL = f"""SELECT pos AS id, {_FIELDS} FROM feed_rows
WHERE pos IN (SELECT pos FROM page_feed ORDER BY "publishedAt" DESC, pos LIMIT 10)"""
_HEADLINE_ROWS_SQL = f"{_PAGE_MODELS_SQL}, {_FEED_ROWS_SQL}, digest_rows AS MATERIALIZED ({_LATEST_ROWS_SQL})"
_DIGEST_ROWS_SQL = f"""
{_PAGE_MODELS_SQL}, {_FEED_ROWS_SQL}, {_FILE_ROWS_SQL},
digest_rows AS MATERIALIZED (
{_LATEST_ROWS_SQL}
UNION ALL SELECT (1::BIGINT << {D._PATH_BITS}) + pos, {_FIELDS} FROM file_rows
UNION ALL
SELECT (2::BIGINT << {D._PATH_BITS}) + page_id, CASE WHEN page_title <> '' THEN page_title ELSE 'Untitled Article' END, url,
       'External Link', 'Unknown', 'Unknown', content, summary, sentiment, score
FROM pages JOIN enriched USING (url))"""
_CLUSTERED_ROWS_SQL = f"""
SELECT {_FIELDS}, cluster_id, cluster_label
FROM (SELECT * EXCLUDE (content), content FROM digest_rows) JOIN (SELECT id, cluster_id FROM clustered) USING (id) JOIN labels USING (cluster_id)"""
_TOPICS_SQL = f"""
{topics_sql(GLOBAL_SLOTS_SQL.format('clustered'), TOPIC_NUMBER_SQL.format('clustered'))}, {RANKED_TOPICS_SQL}
SELECT cluster_id, cluster_label, l[1] AS primary_focus, array_to_string(l[2:], ' | ') AS related_topics FROM ranked JOIN labels USING (cluster_id)"""
_ALL_TEXTS_SQL = "texts AS (SELECT doc_id AS id, text AS content FROM documents)"


QUERIES = {
    "enrich_feed": feed_rows,
    "enrich_files": file_rows,
    "enrich_urls": url_rows,
    "union_paths": all_rows,
    "cluster_counts": view_counts,
    "cluster_view": view_clusters,
    "cluster_markdown": view_markdown,
    "csv_roundtrip": csv_roundtrip,
    "json_roundtrip": json_roundtrip,
    "digest_csv": digest_csv,
    "records_table": landed_records,
    "read_text_files": text_files,
    "model_summary": model_summary,
    "model_sentiment": model_sentiment,
    "model_vectors": model_vectors,
    "cluster_and_label": label_all,
    "cluster_and_label_topics": topics_of_all,
    "digest_topics": digest_topics,
    "digest": whole_digest,
    "latest_headlines": latest_headlines,
    "digest_articles": digest_articles,
    "headline_articles": headline_articles,
    "landed_rows": landed_rows,
}

_COLUMNS = ", ".join(f'"{c}"' for c in ROW)

ORACLE = {
    "enrich_feed": f"WITH {_PAGE_MODELS_SQL}, {_FEED_ROWS_SQL} SELECT {_COLUMNS} FROM feed_rows",
    "enrich_files": f"WITH {_FILE_ROWS_SQL} SELECT {_COLUMNS} FROM file_rows",
    "enrich_urls": f"WITH {_PAGE_MODELS_SQL}, {_URL_ROWS_SQL} SELECT {_COLUMNS} FROM url_rows",
    "union_paths": f"""
WITH {_PAGE_MODELS_SQL}, {_FEED_ROWS_SQL}, {_FILE_ROWS_SQL}, {_URL_ROWS_SQL}
SELECT {_COLUMNS} FROM feed_rows UNION ALL SELECT {_COLUMNS} FROM file_rows UNION ALL SELECT {_COLUMNS} FROM url_rows""",
    "cluster_counts": f"WITH {_VIEW_SQL} SELECT cluster_label, article_count FROM counts",
    "cluster_view": f"WITH {_VIEW_SQL} SELECT * FROM view",
    "cluster_markdown": MARKDOWN_SQL,
    "csv_roundtrip": RECORDS_SQL,
    "json_roundtrip": RECORDS_SQL,
    "records_table": RECORDS_SQL,
    "digest_csv": DIGEST_CSV_SQL,
    "cluster_and_label": f"WITH {_ALL_TEXTS_SQL}, {clustered_sql('texts')} SELECT id, cluster_id, cluster_label FROM clustered JOIN labels USING (cluster_id)",
    "cluster_and_label_topics": f"WITH {_ALL_TEXTS_SQL}, {clustered_sql('texts')}, {_TOPICS_SQL}",
    "digest": f"WITH {_DIGEST_ROWS_SQL}, {clustered_sql('digest_rows')} {_CLUSTERED_ROWS_SQL}",
    "digest_topics": f"WITH {_DIGEST_ROWS_SQL}, {clustered_sql('digest_rows')}, {_TOPICS_SQL}",
    "latest_headlines": f"WITH {_HEADLINE_ROWS_SQL}, {clustered_sql('digest_rows')} {_CLUSTERED_ROWS_SQL}",
    "digest_articles": f"WITH {_DIGEST_ROWS_SQL} SELECT {_FIELDS} FROM digest_rows",
    "headline_articles": f"WITH {_HEADLINE_ROWS_SQL} SELECT {_FIELDS} FROM digest_rows",
    "landed_rows": LANDED_SQL,
    "read_text_files": TEXT_FILES_SQL,
    **MODEL_SQL,
}
