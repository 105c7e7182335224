"""Whole digests: by topic, files and URLs, or of the latest headlines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.cluster import (
    MAX_CLUSTERS, MIN_CLUSTERS, choose_k,
)
from newsloom.operators.embed import embed
from newsloom.operators.tfidf import TfidfSpace
from newsloom.operators.topics import MAX_TOPICS, TOPICS_SCHEMA, primary_topics
from newsloom.plans.enrich import enrich_feed, enrich_files, enrich_urls, union_paths
from newsloom.session import broadcast_if_small, materialize
from newsloom.sources.feeds import LATEST, latest, latest_per_topic, with_fallback

HEADLINES = "Top Headlines"  # fixed value: names the headline digest

_PATH_BITS = 58  # row ids hold the input path above, the place in it below


@dataclass
class ClusterResult:
    """``articles`` has the digest columns, ``cluster_id`` and ``cluster_label``;
    ``topics`` has one row per cluster."""

    articles: DataFrame
    topics: DataFrame
    k: int


def fetch_content(first: DataFrame, second: DataFrame, by_time: bool = False) -> DataFrame:
    """Per topic the latest entries of the first feed, or of the second if the
    first has none. Both feeds are cut first, so the fallback meets few rows."""
    return with_fallback(
        latest_per_topic(first, LATEST, by_time), latest_per_topic(second, LATEST, by_time),
        covered=first,
    )


def cluster_and_label(
    articles: DataFrame,
    content: str = "content",
    min_clusters: int = MIN_CLUSTERS,
    max_clusters: int = MAX_CLUSTERS,
    max_topics: int = MAX_TOPICS,
    embedder: Callable[[DataFrame, str], DataFrame] = embed,
) -> ClusterResult | None:
    """Cluster articles by content, label each cluster and find its topics.

    ``articles`` has a unique ``id``. Vectors are written next to the articles
    once; clusters and weights are then added row by row, without joins.
    Returns None for no articles; a lone article is cluster 0.
    """
    if articles.isEmpty():
        return None
    base = materialize(embedder(articles, content), "articles")
    n = base.count()
    if n == 1:
        k, clustered = 1, base.withColumn("cluster_id", F.lit(0))
    else:
        clustering = choose_k(base, min_clusters, max_clusters)
        k, clustered = clustering.k, clustering.assign(base)

    space = TfidfSpace(base, content)
    if space.terms:
        vectors = materialize(space.transform(clustered).select("id", "cluster_id", "tfidf"), "tfidf")
        labels = materialize(space.labels(vectors, "cluster_id"), "cluster-labels")
        topics = primary_topics(vectors, space, max_topics)
    else:
        labels = clustered.select("cluster_id").distinct().withColumn("cluster_label", F.lit(""))
        topics = base.sparkSession.createDataFrame([], TOPICS_SCHEMA)
    labelled = with_labels(clustered, labels).select(*articles.columns, "cluster_id", "cluster_label")
    return ClusterResult(labelled, with_labels(topics, labels), k)


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the label of their cluster; ``labels`` has one row per cluster."""
    return rows.join(broadcast_if_small(labels), "cluster_id")


def with_row_id(rows: DataFrame) -> DataFrame:
    """A unique ``id`` in order of input path and place; needs no shuffle."""
    path = F.shiftleft(F.col("path_ord").cast("long"), _PATH_BITS)
    return rows.withColumn("id", path + F.col("pos")).drop("path_ord", "pos")


def digest(
    feed: DataFrame | None = None,
    files: DataFrame | None = None,
    urls: DataFrame | None = None,
    pages: DataFrame | None = None,
    **models,
) -> ClusterResult | None:
    """Digest of feed entries, text files ``(pos, content)`` and URLs ``(pos, url)``.

    ``pos`` is unique within each of them; ``sources.files.numbered`` makes it for
    rows that were read from several files.
    """
    paths = []
    if feed is not None:
        paths.append(enrich_feed(feed, pages, **models))
    if files is not None:
        paths.append(enrich_files(files, **models))
    if urls is not None:
        paths.append(enrich_urls(urls, pages, **models))
    if not paths:
        return None
    return cluster_and_label(materialize(with_row_id(union_paths(*paths)), "digest-rows"))


def latest_headlines(feed: DataFrame, pages: DataFrame, by_time: bool = False, **models) -> ClusterResult | None:
    """Digest of the latest entries of one feed; there is no second feed."""
    return digest(feed=latest(feed, LATEST, by_time), pages=pages, **models)
