"""From URLs and files to digest rows: text, summary, sentiment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.once import with_once
from newsloom.functions.sentiment import with_sentiment
from newsloom.functions.summary import NO_INPUT, with_summary
from newsloom.functions.text import CHUNK_WORDS, LONG_WORD, chunks_of, is_blank, words
from newsloom.operators.lookup import lookup
from newsloom.schema import DIGEST_FIELDS
from newsloom.sources.feeds import API_DEFAULTS, with_defaults
from newsloom.sources.pages import ARTICLE, page_texts

Step = Callable[[DataFrame], DataFrame]

# What fills the fields that a path does not know.
FILE_FIELDS = {
    "title": "Custom File", "url": "N/A", "source": "Uploaded File", "author": "Unknown",
    "publishedAt": "Unknown",
}
URL_FIELDS = {"source": "External Link", "author": "Unknown", "publishedAt": "Unknown"}
UNTITLED_ARTICLE = "Untitled Article"


def summarize_and_score(
    df: DataFrame, summarizer: Step = with_summary, scorer: Step = with_sentiment
) -> DataFrame:
    """``summarizer`` adds ``summary`` from ``content``; ``scorer`` adds ``sentiment``
    and ``score`` from ``summary``."""
    return scorer(summarizer(df))


def _digest_rows(df: DataFrame, path: int) -> DataFrame:
    return df.select(F.lit(path).alias("path_ord"), "pos", *DIGEST_FIELDS)


def _enriched_pages(rows, pages, extractor, models) -> DataFrame:
    """Each distinct page is summarised and scored once, however often it is named."""
    texts = page_texts(rows, pages, extractor).withColumnRenamed("text", "content")
    return summarize_and_score(texts, **models)


def enrich_feed(feed: DataFrame, pages: DataFrame, extractor: str = ARTICLE, **models) -> DataFrame:
    """Digest rows of feed entries that have a page with enough text; the feed's title stands."""
    rows = with_defaults(feed.where(F.col("url") != "")).select("pos", *API_DEFAULTS)
    enriched = _enriched_pages(rows, pages, extractor, models).drop("page_title")
    return _digest_rows(lookup(rows, enriched, "url", "pos"), 0)


def enrich_files(files: DataFrame, **models) -> DataFrame:
    """Digest rows of text files ``(pos, content)``; there is no minimum length."""
    rows = files.where(~is_blank(F.col("content"))).select("pos", "content")
    fields = {c: F.lit(v) for c, v in FILE_FIELDS.items()}
    return _digest_rows(summarize_and_score(rows, **models).withColumns(fields), 1)


def enrich_urls(urls: DataFrame, pages: DataFrame, extractor: str = ARTICLE, **models) -> DataFrame:
    """Digest rows of listed URLs, repeats kept; the page's own title stands."""
    rows = urls.where(F.col("url") != "").select("pos", "url")
    enriched = _enriched_pages(rows, pages, extractor, models)
    fields: dict[str, Column] = {c: F.lit(v) for c, v in URL_FIELDS.items()}
    fields["title"] = F.when(F.length("page_title") > 0, F.col("page_title")).otherwise(
        UNTITLED_ARTICLE
    )
    return _digest_rows(lookup(rows, enriched, "url", "pos").withColumns(fields), 2)


def union_paths(*paths: DataFrame) -> DataFrame:
    """Append the rows of all paths; a URL named in two paths stays twice."""
    first, *others = paths
    for other in others:
        first = first.unionByName(other)
    return first


def clean_chunks(df: DataFrame, content: str = "content", size: int = CHUNK_WORDS) -> DataFrame:
    """``(id, i, chunk)``: cleaned text in runs of ``size`` words."""
    kept = F.filter(words(F.col(content)), lambda w: F.length(w) < LONG_WORD)
    pieces = with_once(df.select("id", kept.alias("_w")), chunks=chunks_of(F.col("_w"), size))
    return pieces.select("id", F.posexplode("chunks").alias("i", "chunk"))


def summarize_by_chunks(
    df: DataFrame, content: str = "content", size: int = CHUNK_WORDS, summarizer: Step | None = None
) -> DataFrame:
    """``(id, summary)``: the chunk summaries of each article, joined without a gap.

    Chunks are summarised where they are made; only their summaries meet again.
    ``summarizer`` adds ``summary`` from ``content``.
    """
    chunks = clean_chunks(df, content, size).withColumnRenamed("chunk", "content")
    summarised = (summarizer or with_summary)(chunks)
    in_order = F.array_sort(F.collect_list(F.struct("i", "summary")))  # one article's chunks
    joined = summarised.groupBy("id").agg(
        F.array_join(F.transform(in_order, lambda x: x["summary"]), "").alias("summary")
    )
    blank = df.select("id", is_blank(F.col(content)).alias("_blank"))
    return blank.join(joined, "id", "left").select(
        "id",
        F.when(F.col("_blank"), NO_INPUT).otherwise(F.coalesce("summary", F.lit(""))).alias("summary"),
    )
