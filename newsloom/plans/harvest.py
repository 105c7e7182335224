"""Batch harvest of articles from a URL list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.urls import is_acceptable_url, is_paywalled_content
from newsloom.operators.lookup import first_per_key
from newsloom.session import materialize
from newsloom.sources.pages import PARAGRAPHS, texts_of

OK = 200  # fixed value: the status of a link that works


def distinct_urls(urls: DataFrame) -> DataFrame:
    """``(url, pos)``: each URL at the place where it first stands."""
    return first_per_key(urls, "url", "pos")


def reachable(urls: DataFrame, link_status: DataFrame) -> DataFrame:
    """URLs whose landed status is 200; an unknown URL counts as broken."""
    working = link_status.where(F.col("status") == OK).select("url").distinct()
    return urls.join(working, "url", "left_semi")


def acceptable(urls: DataFrame, link_status: DataFrame | None = None) -> DataFrame:
    kept = urls.where(is_acceptable_url(F.col("url")))
    return kept if link_status is None else reachable(kept, link_status)


def harvest(
    urls: DataFrame,
    pages: DataFrame,
    link_status: DataFrame | None = None,
    extractor: str = PARAGRAPHS,
) -> DataFrame:
    """``(pos, url, title, text)`` of acceptable, distinct URLs with enough text.

    Acceptance depends on the URL alone, so repeats are folded right after the
    cheap checks; a URL whose page fails is not tried again at a later place.
    """
    chosen = distinct_urls(urls.where(is_acceptable_url(F.col("url"))))
    if link_status is not None:
        chosen = reachable(chosen, link_status)
    chosen = materialize(chosen, "harvest-urls")  # short rows, used more than once
    texts = texts_of(chosen.select("url"), pages, extractor)
    return (
        chosen.join(texts, "url")
        .where(~is_paywalled_content(F.col("url"), F.col("text")))
        .select("pos", "url", F.col("page_title").alias("title"), "text")
    )


