"""Tables, derived inputs and SQL fragments that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.functions.stopwords import STOP_WORDS
from newsloom.functions.summary import SENTENCE
from newsloom.functions.text import SPACE_CHARACTERS, TOKEN
from newsloom.session import spread

# Words that do occur in the test documents; the polarity is ours.
LEXICON = {
    **dict.fromkeys("then only here rest rely rent ones restore resting heat".split(), 1),
    **dict.fromkeys("than thin thing worthless hated heed shed tier".split(), -1),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


STOP_SQL = sql_list(STOP_WORDS)


def sql_strip(expr: str) -> str:
    return f"trim({expr}, '{SPACE_CHARACTERS}')"


def sql_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{TOKEN}')"


def sql_content_tokens(expr: str) -> str:
    return f"list_filter({sql_tokens(expr)}, lambda w: NOT list_contains({STOP_SQL}, w))"


# White space in RE2, whose \\s is ASCII only.
_SPACE_RUN = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"


def sql_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{_SPACE_RUN}'), lambda w: length(w) > 0)"


# ---------------------------------------------------------------- feed

def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A news feed made from ``documents``, with missing authors and dates."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 97).cast("int"))
    return d.select(
        i.alias("pos"),
        F.concat("source", F.lit(" "), "lang", F.lit(" "), i.cast("string")).alias("title"),
        F.concat_ws("/", F.concat(F.lit("https://"), "source", F.lit(".example.org")), "lang", i.cast("string")).alias("url"),
        "source",
        F.when(i % 7 != 0, F.concat(F.lit("author"), (i % 13).cast("string"))).alias("author"),
        F.when(i % 11 != 0, day.cast("string")).alias("publishedAt"),
        "lang",
        F.col("text").alias("content"),
    )


FEED_SQL = """
feed AS (
  SELECT doc_id AS pos, source || ' ' || lang || ' ' || doc_id AS title,
         'https://' || source || '.example.org/' || lang || '/' || doc_id AS url, source,
         CASE WHEN doc_id % 7 <> 0 THEN 'author' || (doc_id % 13) END AS author,
         CASE WHEN doc_id % 11 <> 0
              THEN CAST(DATE '2024-01-01' + CAST(doc_id % 97 AS INTEGER) AS VARCHAR) END AS "publishedAt",
         lang, text AS content
  FROM documents)"""


# ---------------------------------------------------------------- pages

def page_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed whose entries have landed pages."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return p.select(
        F.col("page_id").alias("pos"),
        F.concat(F.lit("Entry "), F.col("page_id").cast("string")).alias("title"),
        "url",
        host.alias("source"),
        F.lit(None).cast("string").alias("author"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 97).cast("int"))
        .cast("string").alias("publishedAt"),
    )


PAGE_FEED_SQL = """
page_feed AS (
  SELECT page_id AS pos, 'Entry ' || page_id AS title, url,
         regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS source, CAST(NULL AS VARCHAR) AS author,
         CAST(DATE '2024-01-01' + CAST(page_id % 97 AS INTEGER) AS VARCHAR) AS "publishedAt"
  FROM pages)"""

REPEAT = 1_000_000_000_000


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A URL list with repeats: every page, every page again, and its host alone."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    again = F.array(F.col("url"), F.col("url"), host, F.concat(F.col("url"), F.lit("/premium")))
    return p.select("page_id", F.posexplode(again).alias("_i", "url")).select(
        (F.col("page_id") + F.col("_i") * REPEAT).alias("pos"), "url"
    )


PAGE_URLS_SQL = f"""
page_urls AS (
  SELECT page_id + i * {REPEAT} AS pos,
         CASE i WHEN 2 THEN regexp_extract(url, '^[a-z]+://[^/]+') WHEN 3 THEN url || '/premium' ELSE url END AS url
  FROM pages, (VALUES (0), (1), (2), (3)) AS t(i))"""


def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page that was cut off before its end tag counts as a failed request."""
    whole = F.col("html").endswith("</html>")
    return table(spark, sf_dir, "pages").select(
        "url", F.when(whole, 200).otherwise(500).alias("status")
    )


def sql_decoded(expr: str) -> str:
    """Named character references; the test pages have no numbered ones."""
    named = ", ".join(f"{sql_text(n)}: {sql_text(c)}" for n, c in H.NAMED.items())
    reference = f"regexp_extract(p, '{H.REFERENCE}')"
    piece = (
        f"coalesce(MAP {{{named}}}[regexp_replace({reference}, ';$', '')] || "
        f"substring(p, length({reference}) + 1), '&' || p)"
    )
    parts = f"string_split({expr}, '&')"
    return f"({parts}[1] || array_to_string(list_transform({parts}[2:], lambda p: {piece}), ''))"


def sql_paragraphs(scope: str) -> str:
    cut = f"regexp_replace(p, '{H.PARAGRAPH_END}', '')"
    texts = (
        f"list_transform(regexp_split_to_array({scope}, '{H.PARAGRAPH_START}')[2:], "
        f"lambda p: regexp_replace({cut}, '{H.TAG}', '', 'g'))"
    )
    return sql_strip(sql_decoded(f"array_to_string({texts}, ' ')"))


def page_text_sql(extractor: str, name: str = "page_text") -> str:
    """CTEs ending in ``name(page_id, url, title, text)``: the first page of each URL."""
    scope = "visible"
    if extractor == "article":
        inner = f"regexp_extract(visible, '{H.ARTICLE}', 1)"
        scope = f"CASE WHEN {inner} = '' THEN visible ELSE {inner} END"
    raw = f"regexp_extract(visible, '{H.TITLE}', 1)"
    return f"""
{name}_visible AS (
  SELECT page_id, url, regexp_replace(html, '{H.INVISIBLE}', '', 'g') AS visible
  FROM pages JOIN (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) USING (url, page_id)),
{name} AS (
  SELECT * FROM (
    SELECT page_id, url,
           CASE WHEN {raw} = '' THEN 'Untitled' ELSE {sql_strip(sql_decoded(raw))} END AS title,
           {sql_paragraphs(scope)} AS text
    FROM {name}_visible)
  WHERE length(text) >= {H.MIN_LENGTH})"""


# ---------------------------------------------------------------- models

def summary_sql(source: str, name: str = "summarised") -> str:
    """CTEs ending in ``name(id, summary)`` for ``source(id, content)``."""
    found = f"regexp_extract_all(content, '{SENTENCE}')"
    sentences = f"list_filter(list_transform({found}, lambda s: {sql_strip('s')}), lambda s: length(s) > 0)"
    return f"""
{name}_l AS (SELECT id, {sentences} AS l FROM {source}),
{name}_s AS (SELECT id, unnest(l) AS sentence, unnest(range(len(l))) AS s FROM {name}_l),
{name}_w AS (SELECT id, s, unnest({sql_content_tokens('sentence')}) AS w FROM {name}_s),
{name}_c AS (SELECT id, w, count(*) AS n FROM {name}_w GROUP BY id, w),
{name}_score AS (
  SELECT id, s, CAST(sum(n) AS DOUBLE) / count(*) AS score
  FROM {name}_w JOIN {name}_c USING (id, w) GROUP BY id, s),
{name}_rank AS (
  SELECT id, s, sentence,
         row_number() OVER (PARTITION BY id ORDER BY coalesce(score, 0) DESC, s) AS r
  FROM {name}_s LEFT JOIN {name}_score USING (id, s)),
{name}_top AS (
  SELECT id, string_agg(sentence, ' ' ORDER BY s) AS summary FROM {name}_rank WHERE r <= 3 GROUP BY id),
{name} AS (
  SELECT id, CASE WHEN content IS NULL OR length({sql_strip('content')}) = 0 THEN 'No input provided.'
                  ELSE coalesce(summary, '') END AS summary
  FROM {source} LEFT JOIN {name}_top USING (id))"""


def sentiment_sql(source: str, lexicon, name: str = "scored") -> str:
    """CTE ``name(id, sentiment, score)`` for ``source(id, summary)``."""
    total = " + ".join(
        f"({p}) * len(list_filter({sql_tokens('summary')}, lambda w: list_contains("
        f"{sql_list([w for w, v in lexicon.items() if v == p])}, w)))"
        for p in sorted(set(lexicon.values()))
    )
    blank = f"(summary IS NULL OR length({sql_strip('summary')}) = 0)"
    p = "(1.0 / (1.0 + exp(-CAST(x AS DOUBLE))))"
    return f"""
{name} AS (
  SELECT id,
         CASE WHEN {blank} THEN 'No input provided.' WHEN x > 0 THEN 'POSITIVE'
              WHEN x < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment,
         CASE WHEN {blank} THEN 0.0 ELSE round(greatest({p}, 1 - {p}), 9) END AS score
  FROM (SELECT id, summary, {total} AS x FROM {source}))"""
