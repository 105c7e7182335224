"""Text scalars, TF-IDF, summary, sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    LEXICON, STOP_SQL, sentiment_sql, sql_content_tokens, sql_tokens, sql_words, summary_sql, table,
)
from newsloom.functions.once import with_once
from newsloom.functions.sentiment import with_sentiment
from newsloom.functions.stopwords import STOP_WORDS
from newsloom.functions.summary import with_summary
from newsloom.functions.text import CHUNK_WORDS, LONG_WORD, capitalize, clean_text, tokens
from newsloom.operators.tfidf import (
    GROUP_VOCABULARY, VOCABULARY, cluster_keywords, global_labels, group_vocabulary, vocabulary,
    with_terms,
)
from newsloom.plans.digest import with_labels
from newsloom.plans.enrich import clean_chunks, summarize_by_chunks
from newsloom.session import materialize


def _articles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang"
    )


_ARTICLES_SQL = "articles AS (SELECT doc_id AS id, text AS content, lang FROM documents)"


def text_clean(spark, sf_dir):
    return _articles(spark, sf_dir).select("id", clean_text(F.col("content")).alias("cleaned"))


_KEPT = f"list_filter({sql_words('content')}, lambda w: length(w) < {LONG_WORD})"
_CHUNKS_SQL = f"""
{_ARTICLES_SQL},
kept AS (SELECT id, {_KEPT} AS w FROM articles),
numbered AS (SELECT id, w, unnest(range((len(w) + {CHUNK_WORDS - 1}) // {CHUNK_WORDS})) AS i FROM kept),
chunks AS (SELECT id, CAST(i AS INTEGER) AS i,
                  array_to_string(w[i * {CHUNK_WORDS} + 1 : (i + 1) * {CHUNK_WORDS}], ' ') AS chunk FROM numbered)"""


def text_chunks(spark, sf_dir):
    return clean_chunks(_articles(spark, sf_dir))


def sentiment_capitalize(spark, sf_dir):
    """First letter up, the rest down."""
    return _articles(spark, sf_dir).select("id", capitalize(F.col("content")).alias("capitalized"))


def stopword_anti(spark, sf_dir):
    """Word counts without stop words, by an anti join with the stop-word table."""
    stop = spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")
    words = with_once(_articles(spark, sf_dir), words=tokens(F.col("content"))).select(
        F.explode("words").alias("word")
    )
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(stop), "word", "left_anti")


_TERMS_SQL = f"""
{_ARTICLES_SQL},
words AS (SELECT id, lang, {sql_content_tokens('content')} AS w FROM articles),
terms AS (
  SELECT id, lang, unnest(w) AS term FROM words
  UNION ALL
  SELECT id, lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM words)"""


def _docs(spark, sf_dir):
    return with_terms(_articles(spark, sf_dir))


def tfidf_vocabulary(spark, sf_dir):
    return vocabulary(_docs(spark, sf_dir).select("id", "terms"))


def tfidf_cluster_vocabulary(spark, sf_dir):
    return group_vocabulary(_docs(spark, sf_dir), "lang")


def tfidf_cluster_keywords(spark, sf_dir):
    return cluster_keywords(_articles(spark, sf_dir), "lang")


def tfidf_global_labels(spark, sf_dir):
    return global_labels(_articles(spark, sf_dir), "lang")


def label_clusters(spark, sf_dir):
    """Every article with the label of its cluster; the language is the cluster."""
    rows = _articles(spark, sf_dir).withColumnRenamed("lang", "cluster_id")
    labels = materialize(global_labels(rows, "cluster_id"), "cluster-labels")
    return with_labels(rows, labels).select("id", "cluster_id", "cluster_label")


_GROUP_VOCABULARY_SQL = f"""
counts AS (SELECT lang, term, count(*) AS ctf, count(DISTINCT id) AS df FROM terms GROUP BY lang, term),
vocab AS (
  SELECT lang, term, ctf, df FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ctf DESC, term) AS r FROM counts)
  WHERE r <= {GROUP_VOCABULARY})"""

_GROUP_WEIGHTS_SQL = """
sizes AS (SELECT lang, count(*) AS n FROM articles GROUP BY lang),
idfs AS (SELECT lang, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM vocab JOIN sizes USING (lang)),
tf AS (SELECT id, lang, term, count(*) AS tf FROM terms GROUP BY id, lang, term),
w AS (SELECT id, lang, term, tf * idf AS w FROM tf JOIN idfs USING (lang, term)),
unit AS (SELECT lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
means AS (SELECT lang, term, sum(w) / max(n) AS mean FROM unit JOIN sizes USING (lang) GROUP BY lang, term)"""

_LABELS_SQL = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(mean, 9) DESC, term DESC) AS r FROM means),
labels AS (SELECT lang, string_agg(term, ', ' ORDER BY r) AS label FROM ranked WHERE r <= 3 GROUP BY lang)"""

TFIDF_CLUSTER_SQL = f"""
WITH {_TERMS_SQL}, {_GROUP_VOCABULARY_SQL}, {_GROUP_WEIGHTS_SQL}, {_LABELS_SQL}
SELECT lang, coalesce(label, '') AS keywords FROM sizes LEFT JOIN labels USING (lang)"""

_VOCABULARY_SQL = f"""
vocab AS (
  SELECT term, count(*) AS ctf, count(DISTINCT id) AS df FROM terms GROUP BY term
  ORDER BY ctf DESC, term LIMIT {VOCABULARY})"""

TFIDF_GLOBAL_SQL = f"""
WITH {_TERMS_SQL}, {_VOCABULARY_SQL},
sizes AS (SELECT lang, count(*) AS n FROM articles GROUP BY lang),
idfs AS (SELECT term, ln((1 + (SELECT count(*) FROM articles)) / (1 + df)) + 1 AS idf FROM vocab),
tf AS (SELECT id, lang, term, count(*) AS tf FROM terms GROUP BY id, lang, term),
w AS (SELECT id, lang, term, tf * idf AS w FROM tf JOIN idfs USING (term)),
unit AS (SELECT lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
found AS (SELECT lang, term, sum(w) AS total FROM unit GROUP BY lang, term),
means AS (SELECT lang, term, coalesce(total, 0) / n AS mean FROM sizes CROSS JOIN idfs LEFT JOIN found USING (lang, term)),
{_LABELS_SQL}
SELECT lang, label AS cluster_label FROM labels"""

LABEL_CLUSTERS_SQL = f"""
SELECT id, lang AS cluster_id, cluster_label
FROM (SELECT doc_id AS id, lang FROM documents) JOIN ({TFIDF_GLOBAL_SQL}) USING (lang)"""


def summary(spark, sf_dir):
    return with_summary(_articles(spark, sf_dir)).select("id", "summary")


def summary_chunked(spark, sf_dir):
    return summarize_by_chunks(_articles(spark, sf_dir))


def sentiment(spark, sf_dir):
    scored = with_sentiment(_articles(spark, sf_dir), "content", lexicon=LEXICON)
    return scored.select("id", "sentiment", "score")


SUMMARY_CHUNKED_SQL = f"""
WITH {_CHUNKS_SQL},
pieces AS (SELECT id * 1000000 + i AS id, chunk AS content FROM chunks),
{summary_sql('pieces')},
joined AS (SELECT id // 1000000 AS id, string_agg(summary, '' ORDER BY id) AS summary FROM summarised GROUP BY ALL)
SELECT id, CASE WHEN len({sql_words('content')}) = 0 THEN 'No input provided.' ELSE coalesce(summary, '') END AS summary
FROM articles LEFT JOIN joined USING (id)"""

QUERIES = {
    "text_clean": text_clean,
    "text_chunks": text_chunks,
    "sentiment_capitalize": sentiment_capitalize,
    "stopword_anti": stopword_anti,
    "tfidf_vocabulary": tfidf_vocabulary,
    "tfidf_cluster_vocabulary": tfidf_cluster_vocabulary,
    "tfidf_cluster_keywords": tfidf_cluster_keywords,
    "tfidf_global_labels": tfidf_global_labels,
    "label_clusters": label_clusters,
    "summary": summary,
    "summary_chunked": summary_chunked,
    "sentiment": sentiment,
}

ORACLE = {
    "text_clean": f"WITH {_ARTICLES_SQL} SELECT id, array_to_string({_KEPT}, ' ') AS cleaned FROM articles",
    "text_chunks": f"WITH {_CHUNKS_SQL} SELECT id, i, chunk FROM chunks",
    "sentiment_capitalize": f"WITH {_ARTICLES_SQL} SELECT id, upper(substring(content, 1, 1)) || lower(substring(content, 2)) AS capitalized FROM articles",
    "stopword_anti": f"""
WITH {_ARTICLES_SQL}, words AS (SELECT unnest({sql_tokens('content')}) AS word FROM articles)
SELECT word, count(*) AS n FROM words WHERE NOT list_contains({STOP_SQL}, word) GROUP BY word""",
    "tfidf_vocabulary": f"WITH {_TERMS_SQL}, {_VOCABULARY_SQL} SELECT * FROM vocab",
    "tfidf_cluster_vocabulary": f"WITH {_TERMS_SQL}, {_GROUP_VOCABULARY_SQL} SELECT * FROM vocab",
    "tfidf_cluster_keywords": TFIDF_CLUSTER_SQL,
    "tfidf_global_labels": TFIDF_GLOBAL_SQL,
    "label_clusters": LABEL_CLUSTERS_SQL,
    "summary": f"WITH {_ARTICLES_SQL}, {summary_sql('articles')} SELECT id, summary FROM summarised",
    "summary_chunked": SUMMARY_CHUNKED_SQL,
    "sentiment": f"""
WITH texts AS (SELECT doc_id AS id, text AS summary FROM documents), {sentiment_sql('texts', LEXICON)}
SELECT id, sentiment, score FROM scored""",
}
