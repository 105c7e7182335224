"""Pages by URL: a table of landed pages stands for the download."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.functions.once import with_once
from newsloom.operators.lookup import first_per_key, lookup
from newsloom.session import fits_in_broadcast, materialize

PARAGRAPHS = "paragraphs"
ARTICLE = "article"
MAIN = "main"


def extract(
    pages: DataFrame, extractor: str = PARAGRAPHS, min_length: int = H.MIN_LENGTH
) -> DataFrame:
    """Replace ``html`` by ``title`` and ``text``; pages with a short text are dropped.

    ``extractor`` is ``"paragraphs"`` (whole page), ``"article"`` (main article
    element where the page has one) or ``"main"`` (blocks of running text, whatever
    elements they are in).
    """
    if extractor not in (PARAGRAPHS, ARTICLE, MAIN):
        raise ValueError(f"unknown extractor {extractor!r}")
    seen = pages.withColumn("_scope", H.visible(F.col("html")))
    seen = seen.withColumn("_raw", H.raw_title(F.col("_scope")))
    if extractor == ARTICLE:
        seen = seen.withColumn("_article", H.article_element(F.col("_scope"))).withColumn(
            "_scope", F.when(F.col("_article") == "", F.col("_scope")).otherwise(F.col("_article"))
        )
    if extractor == MAIN:
        body = H.main_text(F.col("_parts"))
        seen = with_once(seen, _parts=H.outside(F.col("_scope")))
    else:
        body = H.paragraph_text(F.col("_scope"))
    found = with_once(
        seen.withColumn("_body", body),
        title=H.clean_title(F.col("_raw")), text=H.clean_body(F.col("_body")),
    )
    return found.drop("_scope", "_raw", "_article", "_parts", "_body", "html").where(
        F.length("text") >= min_length
    )


def fetch(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """The page of each of the distinct ``urls``: ``(url, page_id, html)``.

    The page is picked on the two narrow columns first, the lowest ``page_id``
    winning among copies; bodies are read for the picked pages only. A short URL
    list is broadcast, so pages are not shuffled at all; for a long one copies
    are folded before the join, and each picked body moves once.
    """
    keys = pages.select("url", "page_id")
    bodies = pages.select("url", "page_id", "html")
    wanted = urls.select("url")
    if fits_in_broadcast(wanted):
        keys = keys.join(F.broadcast(wanted), "url", "left_semi")
        picked = F.broadcast(first_per_key(keys, "url", "page_id"))
    else:
        picked = first_per_key(keys, "url", "page_id").join(wanted, "url", "left_semi")
    return bodies.join(picked, ["url", "page_id"])


def texts_of(
    urls: DataFrame, pages: DataFrame, extractor: str = ARTICLE, min_length: int = H.MIN_LENGTH
) -> DataFrame:
    """``(url, page_title, text)`` for distinct ``urls``, a stored table.

    Missing pages and short texts give no row.
    """
    texts = extract(fetch(urls, pages), extractor, min_length)
    return texts.select("url", F.col("title").alias("page_title"), "text")


def page_texts(
    rows: DataFrame, pages: DataFrame, extractor: str = ARTICLE, min_length: int = H.MIN_LENGTH
) -> DataFrame:
    """:func:`texts_of` the URLs in ``rows``; a repeated URL is fetched and parsed once."""
    distinct_urls = rows.select("url").where(F.col("url") != "").distinct()
    return texts_of(materialize(distinct_urls, "urls"), pages, extractor, min_length)


def fetch_text(
    rows: DataFrame,
    pages: DataFrame,
    extractor: str = ARTICLE,
    min_length: int = H.MIN_LENGTH,
    how: str = "inner",
) -> DataFrame:
    """Add ``page_title`` and ``text`` to rows with ``pos`` and ``url``.

    ``inner`` drops rows whose page is missing or too short, ``left`` keeps them
    with null text.
    """
    return lookup(rows, page_texts(rows, pages, extractor, min_length), "url", "pos", how)
