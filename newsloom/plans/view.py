"""What a reader sees of a clustered digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import capitalize
from newsloom.session import materialize

COLUMNS_SHOWN = 5  # fixed value
NOTHING = "### ⚠️ No matching articles."  # fixed value


def capitalize_sentiment(articles: DataFrame) -> DataFrame:
    return articles.withColumn("sentiment", capitalize(F.col("sentiment")))


def shown_articles(articles: DataFrame, sentiments: Sequence[str] | None = None) -> DataFrame:
    """Labelled articles whose capitalised sentiment is wanted; no list wants all."""
    rows = capitalize_sentiment(articles).where(F.col("cluster_label").isNotNull())
    return rows.where(F.col("sentiment").isin(list(sentiments))) if sentiments else rows


def topics_by_label(topics: DataFrame) -> DataFrame:
    """One row per label; of clusters with the same label the last one's topics stand."""
    return topics.groupBy("cluster_label").agg(
        F.max_by(F.struct("primary_focus", "related_topics"), "cluster_id").alias("_t")
    ).select("cluster_label", "_t.primary_focus", "_t.related_topics")


def cluster_counts(articles: DataFrame, sentiments: Sequence[str] | None = None) -> DataFrame:
    return shown_articles(articles, sentiments).groupBy("cluster_label").agg(
        F.count(F.lit(1)).alias("article_count")
    )


def cluster_view(
    articles: DataFrame, topics: DataFrame, sentiments: Sequence[str] | None = None,
    columns: int = COLUMNS_SHOWN,
) -> DataFrame:
    """The first ``columns`` clusters in label order, with their topics and article count."""
    first = cluster_counts(articles, sentiments).orderBy("cluster_label").limit(columns)
    return first.join(topics_by_label(topics), "cluster_label", "left").select(
        "cluster_label", "primary_focus", "related_topics", "article_count"
    )


def cluster_markdown(
    articles: DataFrame, topics: DataFrame, sentiments: Sequence[str] | None = None,
    columns: int = COLUMNS_SHOWN,
) -> DataFrame:
    """``(cluster_label, id, markdown)``: per cluster a heading, then one entry per article.

    The heading has a null ``id``. A block is its rows in order of ``id``, heading
    first; entries stay separate rows, so a cluster of any size can be written.
    """
    view = materialize(cluster_view(articles, topics, sentiments, columns), "view")
    related = F.array_join("related_topics", ", ")
    heading = F.concat(
        F.lit("### 🧩 Cluster "), F.col("cluster_label"), F.lit("\n"),
        F.when(
            F.col("primary_focus").isNotNull(),
            F.concat(F.lit("**Primary Topic:** "), F.col("primary_focus"), F.lit("\n\n")),
        ).otherwise(""),
        F.when(
            F.size("related_topics") > 0,
            F.concat(F.lit("**Related Topics:** "), related, F.lit("\n\n")),
        ).otherwise(""),
        F.format_string("**Articles:** %d\n\n", "article_count"),
    )
    entry = F.concat(
        F.lit("#### 📰 "), F.col("title"), F.lit("\n- **Source:** "), F.col("source"),
        F.lit("\n- **Sentiment:** "), F.col("sentiment"),
        F.lit("\n<details><summary><strong>Summary</strong></summary>\n"), F.col("summary"),
        F.lit("\n</details>\n- [Read Full Article]("), F.col("url"), F.lit(")\n\n"),
    )
    labels = F.broadcast(view.select("cluster_label"))  # at most `columns` rows
    entries = (
        shown_articles(articles, sentiments)
        .join(labels, "cluster_label", "left_semi")
        .select("cluster_label", "id", entry.alias("markdown"))
    )
    headings = view.select(
        "cluster_label", F.lit(None).cast("long").alias("id"), heading.alias("markdown")
    )
    return headings.unionByName(entries)


def render_blocks(lines: DataFrame, columns: int = COLUMNS_SHOWN, max_lines: int = 10_000) -> list[str]:
    """The blocks as text for a screen, padded with '' to ``columns``.

    For digests of screen size; a larger one is refused, write its lines instead.
    """
    rows = lines.orderBy("cluster_label", F.asc_nulls_first("id")).take(max_lines + 1)
    if len(rows) > max_lines:
        raise ValueError(f"more than {max_lines} lines; write cluster_markdown() to files instead")
    blocks: dict[str, str] = {}
    for row in rows:
        blocks[row["cluster_label"]] = blocks.get(row["cluster_label"], "") + row["markdown"]
    shown = list(blocks.values()) or [NOTHING]
    return shown + [""] * (columns - len(shown))
