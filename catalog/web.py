"""URLs, pages and harvest."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    PAGE_URLS_SQL, REPEAT, link_status, page_text_sql, page_urls, sql_content_tokens, sql_decoded, sql_strip, table,
)
from newsloom.functions import html as H
from newsloom.functions import urls as U
from newsloom.functions.text import content_tokens
from newsloom.operators.needles import matches, with_contains
from newsloom.plans.harvest import acceptable, distinct_urls, harvest
from newsloom.plans.stream import LANDED, harvest_stream, seen_urls
from newsloom.session import scratch_path
from newsloom.sinks.files import read_csv, write_csv
from newsloom.sources.files import url_list
from newsloom.sources.pages import extract, fetch_text

# Each page URL and variants of it that the checks must tell apart.
VARIANTS = (
    "url",
    "upper(url)",
    "''",
    "CAST(NULL AS {text})",
    "replace(url, 'https://', 'ftps://')",
    "replace(url, 'http', 'htp')",
    "concat(url, ' x')",
    "concat(url, '/premium')",
    "concat(url, '?from=Paywall')",
    "concat('http://localhost:8080/', page_id)",
    "concat('http://10.0.', page_id, '.1/a')",
    "concat('http://[2001:db8::', page_id, ']:80')",
    "concat('https://notexample.com/', page_id)",
    "concat('https://host', page_id)",
    "concat('https://host.org#', page_id)",
)


def _variants(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    each = F.array(*[F.expr(v.format(text="STRING")) for v in VARIANTS])
    return pages.select("page_id", F.posexplode(each).alias("variant", "url"))


def url_checks(spark, sf_dir):
    u = F.col("url")
    return _variants(spark, sf_dir).select(
        "page_id", "variant", "url",
        U.is_valid_url(u).alias("valid"),
        U.is_paywalled(u).alias("paywalled"),
        U.is_blocked_site(u).alias("blocked"),
        U.is_acceptable_url(u).alias("acceptable"),
    )


_VARIANTS_SQL = "\n    UNION ALL ".join(
    f"SELECT page_id, {i} AS variant, {v.format(text='VARCHAR')} AS url FROM pages"
    for i, v in enumerate(VARIANTS)
)
_VALID = f"coalesce(regexp_matches(url, '{U.URL_PATTERN}', 'i'), false)"


def _contains(needles):
    return "coalesce(" + " OR ".join(f"contains(url, '{n}')" for n in needles) + ", false)"


_PAYWALLED = _contains(U.PAYWALL_INDICATORS)
_ACCEPTABLE = f"(coalesce(url <> '', false) AND {_VALID} AND NOT {_PAYWALLED})"

URL_CHECKS_SQL = f"""
SELECT page_id, variant, url, {_VALID} AS valid, {_PAYWALLED} AS paywalled,
       {_contains(U.BLOCKED_SITES)} AS blocked, {_ACCEPTABLE} AS acceptable
FROM ({_VARIANTS_SQL})"""


def article_checks(spark, sf_dir):
    """Content predicates on pages with text, with blank text and without text."""
    pages = table(spark, sf_dir, "pages")
    texts = F.array(
        F.col("html"), F.lit(""), F.lit(" "), F.lit(None).cast("string")
    )
    rows = pages.select("page_id", "url", F.posexplode(texts).alias("variant", "text"))
    paywalled = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/premium"))).otherwise(F.col("url"))
    rows = rows.withColumn("url", paywalled)
    return rows.select(
        "page_id", "variant",
        U.is_empty_content(F.col("text")).alias("is_empty"),
        U.is_paywalled_content(F.col("url"), F.col("text")).alias("paywalled"),
        U.is_blocked_content(F.col("url"), F.col("text")).alias("blocked"),
    )


ARTICLE_CHECKS_SQL = f"""
SELECT page_id, variant, (text IS NULL OR text = '') AS is_empty,
       NOT (text IS NULL OR text = '') AND {_PAYWALLED} AS paywalled,
       NOT (text IS NULL OR text = '') AND {_contains(U.BLOCKED_SITES)} AS blocked
FROM (SELECT page_id, variant,
             CASE WHEN page_id % 2 = 0 THEN url || '/premium' ELSE url END AS url,
             CASE variant WHEN 0 THEN html WHEN 1 THEN '' WHEN 2 THEN ' ' END AS text
      FROM pages, (VALUES (0), (1), (2), (3)) AS t(variant))"""


def _word_needles(spark, sf_dir):
    """Every different content word of the documents, as a list of indicators."""
    words = content_tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select(F.explode(words).alias("needle"))


_NEEDLES_SQL = f"needles AS (SELECT DISTINCT unnest({sql_content_tokens("coalesce(text, '')")}) AS needle FROM documents)"


def needle_matches(spark, sf_dir):
    """How many of the words each different page URL contains, and the first of them."""
    found = matches(table(spark, sf_dir, "pages"), "url", _word_needles(spark, sf_dir), "needle")
    return found.groupBy(F.col("text").alias("url")).agg(F.count(F.lit(1)).alias("needles"), F.min("needle").alias("first"))


def needle_flags(spark, sf_dir):
    """Which variants of page URLs a list of all the documents' words would block."""
    rows = _variants(spark, sf_dir)
    return with_contains(rows, "url", _word_needles(spark, sf_dir), "needle", "listed").select("page_id", "variant", "url", "listed")


def stream_urls(spark, sf_dir):
    """Page URLs that land in two parts, each read by a run of the stream of its own."""
    landing, folder, checkpoint = (scratch_path(spark, f"stream-{name}") for name in ("landing", "seen", "checkpoint"))
    rows = page_urls(spark, sf_dir).selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in LANDED.split(", ")])
    for part in (F.col("pos") < REPEAT, F.col("pos") >= REPEAT):
        rows.where(part).write.mode("append").parquet(landing)
        harvest_stream(spark, landing, folder, checkpoint).awaitTermination()
    return seen_urls(spark, folder).select("url", "pos")


def url_dedup(spark, sf_dir):
    return distinct_urls(page_urls(spark, sf_dir)).select("pos", "url")


URL_DEDUP_SQL = f"WITH {PAGE_URLS_SQL} SELECT min(pos) AS pos, url FROM page_urls GROUP BY url"


def url_reachable(spark, sf_dir):
    """Acceptable URLs whose landed status is good."""
    return acceptable(page_urls(spark, sf_dir), link_status(spark, sf_dir)).select("pos", "url")


_WORKING = "url IN (SELECT url FROM pages WHERE html LIKE '%</html>')"
URL_REACHABLE_SQL = f"""
WITH {PAGE_URLS_SQL}
SELECT pos, url FROM page_urls WHERE {_ACCEPTABLE} AND {_WORKING}"""


def pasted_urls(spark, sf_dir):
    """One pasted box per page: a URL, a blank line, an indented URL, a tab."""
    pages = table(spark, sf_dir, "pages")
    box = F.concat(F.col("url"), F.lit("\n\n  "), F.col("url"), F.lit("/next \r\n\t\n"))
    return url_list(pages.select("page_id", box.alias("box")), "box", "page_id")


URL_LIST_SQL = f"""
SELECT page_id, pos, url FROM (
  SELECT page_id, CAST(unnest(range(len(l))) AS BIGINT) AS pos, {sql_strip('unnest(l)')} AS url
  FROM (SELECT page_id, string_split(url || chr(10) || chr(10) || '  ' || url || '/next ' || chr(13) || chr(10) || chr(9) || chr(10), chr(10)) AS l
        FROM pages))
WHERE length(url) > 0"""


def page_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where(U.is_valid_url(F.col("url")))
    return extract(pages).select("page_id", "url", "title", "text")


PAGE_EXTRACT_SQL = f"WITH {page_text_sql('paragraphs')} SELECT page_id, url, title, text FROM page_text WHERE {_VALID}"


def page_lookup(spark, sf_dir):
    """Every listed URL with its text, null where there is no page."""
    found = fetch_text(page_urls(spark, sf_dir), table(spark, sf_dir, "pages"), how="left")
    return found.select("pos", "url", F.col("page_title").alias("title"), "text")


PAGE_LOOKUP_SQL = f"""
WITH {PAGE_URLS_SQL}, {page_text_sql('article')}
SELECT pos, url, title, text FROM page_urls LEFT JOIN page_text USING (url)"""


def _harvest(extractor):
    def run(spark, sf_dir):
        return harvest(
            page_urls(spark, sf_dir), table(spark, sf_dir, "pages"),
            link_status(spark, sf_dir), extractor,
        )

    return run


def _harvest_sql(extractor):
    return f"""
WITH {PAGE_URLS_SQL}, {page_text_sql(extractor)}
SELECT pos, url, title, text
FROM (SELECT url, min(pos) AS pos FROM page_urls WHERE {_ACCEPTABLE} AND {_WORKING} GROUP BY url)
JOIN page_text USING (url)"""


def harvest_csv(spark, sf_dir):
    """The harvest, written as CSV and read back whole."""
    rows = _harvest("paragraphs")(spark, sf_dir)
    path = scratch_path(spark, "harvest-csv")
    write_csv(rows, path)
    return read_csv(spark, path, rows.schema)


def page_main(spark, sf_dir):
    """Title and running text of pages whose article elements are plain divisions."""
    plain = F.replace(F.replace("html", F.lit("<article>"), F.lit("<div>")), F.lit("</article>"), F.lit("</div>"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", plain.alias("html"))
    return extract(pages, "main").select("page_id", "url", "title", "text")


_RAW_TITLE = f"regexp_extract(visible, '{H.TITLE}', 1)"
PAGE_MAIN_SQL = f"""
WITH shown AS (
  SELECT page_id, url, regexp_replace(replace(replace(html, '<article>', '<div>'), '</article>', '</div>'), '{H.INVISIBLE}', '', 'g') AS visible FROM pages),
tags AS (
  SELECT page_id, unnest(range(1, len(l) + 1)) AS i, CASE WHEN starts_with(unnest(l), '</') THEN -1 ELSE 1 END AS d
  FROM (SELECT page_id, regexp_extract_all(visible, '{H.AROUND}') AS l FROM shown)),
sums AS (SELECT page_id, i, sum(d) OVER (PARTITION BY page_id ORDER BY i) AS s FROM tags),
depths AS (SELECT page_id, i, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS depth FROM sums),
parts AS (
  SELECT page_id, unnest(range(0, len(l))) AS i, unnest(l) AS part FROM (SELECT page_id, regexp_split_to_array(visible, '{H.AROUND}') AS l FROM shown)),
kept AS (
  SELECT page_id, string_agg(part, '<p>' ORDER BY i) AS html FROM parts LEFT JOIN depths USING (page_id, i)
  WHERE coalesce(depth, 0) = 0 GROUP BY page_id),
blocks AS (
  SELECT page_id, unnest(range(0, len(l))) AS i, unnest(l) AS block FROM (SELECT page_id, regexp_split_to_array(html, '{H.BLOCK}') AS l FROM kept)),
measured AS (
  SELECT page_id, i, {sql_strip(f"regexp_replace(block, '{H.TAG}', '', 'g')")} AS text,
         length(regexp_replace(array_to_string(regexp_extract_all(block, '{H.LINK}', 1), ''), '{H.TAG}', '', 'g')) AS linked FROM blocks),
bodies AS (
  SELECT page_id, string_agg(text, ' ' ORDER BY i) AS body FROM measured
  WHERE length(text) >= {H.BLOCK_LENGTH} AND linked * {H.LINKED} <= length(text) GROUP BY page_id)
SELECT * FROM (
  SELECT page_id, url, CASE WHEN {_RAW_TITLE} = '' THEN 'Untitled' ELSE {sql_strip(sql_decoded(_RAW_TITLE))} END AS title, {sql_strip(sql_decoded('body'))} AS text
  FROM shown JOIN bodies USING (page_id))
WHERE length(text) >= {H.MIN_LENGTH}"""


QUERIES = {
    "page_main": page_main,
    "url_checks": url_checks,
    "article_checks": article_checks,
    "url_dedup": url_dedup,
    "needle_matches": needle_matches,
    "needle_flags": needle_flags,
    "stream_urls": stream_urls,
    "url_reachable": url_reachable,
    "url_list": pasted_urls,
    "page_extract": page_extract,
    "page_lookup": page_lookup,
    "harvest": _harvest("paragraphs"),
    "harvest_article": _harvest("article"),
    "harvest_csv": harvest_csv,
}

ORACLE = {
    "page_main": PAGE_MAIN_SQL,
    "url_checks": URL_CHECKS_SQL,
    "article_checks": ARTICLE_CHECKS_SQL,
    "url_dedup": URL_DEDUP_SQL,
    "needle_matches": f"""
WITH {_NEEDLES_SQL}, pages_ AS (SELECT DISTINCT url FROM pages)
SELECT url, count(*) AS needles, min(needle) AS first FROM pages_ JOIN needles ON contains(url, needle) GROUP BY url""",
    "needle_flags": f"""
WITH {_NEEDLES_SQL}, variants AS ({_VARIANTS_SQL}), hit AS (
  SELECT DISTINCT url FROM (SELECT DISTINCT url FROM variants) JOIN needles ON contains(url, needle))
SELECT page_id, variant, variants.url, hit.url IS NOT NULL AS listed FROM variants LEFT JOIN hit ON hit.url = variants.url""",
    "stream_urls": f"WITH {PAGE_URLS_SQL} SELECT min(pos) AS pos, url FROM page_urls WHERE {_ACCEPTABLE} GROUP BY url",
    "url_reachable": URL_REACHABLE_SQL,
    "url_list": URL_LIST_SQL,
    "page_extract": PAGE_EXTRACT_SQL,
    "page_lookup": PAGE_LOOKUP_SQL,
    "harvest": _harvest_sql("paragraphs"),
    "harvest_article": _harvest_sql("article"),
    "harvest_csv": _harvest_sql("paragraphs"),
}
