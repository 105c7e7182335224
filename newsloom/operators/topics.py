"""Topics within each cluster: one variational fit for all clusters at once.

The model is block-diagonal: each cluster has a topic-by-term matrix of its own, and
one pass over the texts updates them all. In a pass the words of a text are shared
out to the topics of its cluster by the topics' term weights, the text's share of
each topic is added up, and the words are shared out again with it; the sums per
cluster, term and topic make the next weights. Those sums are all that leaves the
tasks: clusters x terms x topics numbers, whatever the number of texts. Clusters whose
matrices together pass ``MODEL`` numbers are fitted in several lots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.cluster import SEED
from newsloom.operators.tfidf import KEYWORDS, VOCABULARY, TfidfSpace, group_vectors
from newsloom.session import materialize

# Fixed values.
TOPICS = 2
MAX_TOPICS = 3

ROUNDS = 10
#: Times the words of a text are shared out in a pass: first evenly, then by the text's topics.
SHARES = 2
#: Numbers of a lot of matrices, which every task holds.
MODEL = 4_000_000
TOPICS_SCHEMA = "cluster_id int, primary_focus string, related_topics array<string>"


class Cluster(NamedTuple):
    id: int
    topics: int
    terms: list[str]  # in sorted order


def start(term: str, topic: int, seed: int) -> float:
    """From 0.5 to 1.5: how much of a term's weight a topic starts with, by a hash."""
    return 0.5 + int(hashlib.md5(f"{seed}:{topic}:{term}".encode()).hexdigest()[:13], 16) / 2.0**52


class _Lot:
    """Some clusters, their places in one long matrix, and its term weights."""

    def __init__(self, clusters: list[Cluster]):
        self.ids = np.asarray([c.id for c in clusters])
        self.topics = np.asarray([c.topics for c in clusters])
        sizes = [len(c.terms) for c in clusters]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.of = np.repeat(np.arange(len(clusters)), sizes)
        self.k = int(self.topics.max())
        #: 1 for the topics that the cluster of a place has.
        self.has = (np.arange(self.k)[None, :] < self.topics[self.of][:, None]).astype(float)
        self.weights = np.zeros((int(self.offsets[-1]), self.k))

    def weigh(self, sums: np.ndarray) -> None:
        """Term weights of each topic, from its sums with 1 / topics added to each."""
        more = 1.0 / self.topics
        total = np.zeros((len(self.ids), self.k))
        np.add.at(total, self.of, sums)
        smooth = (more * np.diff(self.offsets))[:, None]
        self.weights = (sums + more[self.of][:, None]) / (total + smooth)[self.of] * self.has

    def share(self, clusters: np.ndarray, rows: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Each word's weight, shared out to topics; ``rows`` is the text of a word."""
        weights = self.weights[places]
        pull = np.ones((len(clusters), self.k))
        for _ in range(SHARES):
            given = weights * pull[rows]
            given *= (values / given.sum(axis=1))[:, None]
            added = [np.bincount(rows, given[:, i], len(clusters)) for i in range(self.k)]
            pull = np.stack(added, axis=1) + (1.0 / self.topics)[clusters][:, None]
        return given


def _sums(rows: DataFrame, lot: _Lot, share: bool) -> np.ndarray:
    """The sums per place and topic over all texts; without ``share`` whole weights in the first column."""
    names = [f"n{i}" for i in range(lot.k)]
    known = rows.sparkSession.sparkContext.broadcast(lot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        total = np.zeros(own.weights.shape)
        for batch in batches:
            clusters = np.searchsorted(own.ids, batch.column(0).to_numpy())
            lengths = np.diff(batch.column(1).offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
            texts = np.repeat(np.arange(batch.num_rows), lengths)
            places = own.offsets[clusters][texts] + batch.column(1).flatten().to_numpy()
            values = batch.column(2).flatten().to_numpy()
            if share:
                given = own.share(clusters, texts, places, values)
                for i in range(own.k):
                    total[:, i] += np.bincount(places, given[:, i], len(total))
            else:
                total[:, 0] += np.bincount(places, values, len(total))
        found = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *(pa.array(c) for c in total[found].T)], ["place", *names])

    parts = rows.select("cluster_id", "idx", "val").mapInArrow(run, "place long, " + ", ".join(f"{n} double" for n in names))
    table = parts.groupBy("place").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # at most MODEL numbers
    out = np.zeros(lot.weights.shape)
    out[table.column("place").to_numpy()] = np.stack([table.column(n).to_numpy() for n in names], axis=1)
    return out


def fit_topics(rows: DataFrame, clusters: list[Cluster], rounds: int = ROUNDS, seed: int = SEED) -> dict[int, np.ndarray]:
    """The term-by-topic sums of each cluster after ``rounds`` passes.

    ``rows`` has ``cluster_id``, ``idx array<int>`` (places in the cluster's terms) and
    ``val array<double>`` of each text.
    """
    lots: list[list[Cluster]] = []
    size = MODEL
    for cluster in sorted(clusters):
        own = len(cluster.terms) * cluster.topics
        if size + own > MODEL:
            lots.append([])
            size = 0
        lots[-1].append(cluster)
        size += own
    found: dict[int, np.ndarray] = {}
    for some in lots:
        lot = _Lot(some)
        texts = rows.where(F.col("cluster_id").isin([c.id for c in some]))
        whole = _sums(texts, lot, share=False)[:, :1]
        shares = np.asarray([[start(t, i, seed) / c.topics if i < c.topics else 0.0 for i in range(lot.k)] for c in some for t in c.terms])
        lot.weigh(whole * shares)
        for _ in range(rounds):
            sums = _sums(texts, lot, share=True)
            lot.weigh(sums)
        for i, cluster in enumerate(some):
            found[cluster.id] = sums[lot.offsets[i] : lot.offsets[i + 1], : cluster.topics]
    return found


def top_terms(sums: np.ndarray, terms: list[str], k: int = KEYWORDS) -> str:
    """Heaviest first, sums compared to 9 places; on a tie the term that sorts last (terms are sorted)."""
    order = np.lexsort((np.arange(len(sums)), np.round(sums, 9)))[::-1][:k]
    return ", ".join(terms[i] for i in order)


def weighted_topics(sums: np.ndarray, terms: list[str]) -> list[tuple[float, str]]:
    """``(weight, top terms)`` per topic, in model order."""
    return [(round(float(own.sum()), 9), top_terms(own, terms)) for own in sums.T]


def rank_topics(weighted: list[tuple[float, str]]) -> list[str]:
    """Heaviest topic first; on a tie the text that sorts last."""
    return [text for _, text in sorted(weighted, reverse=True)]


def _entries(vectors: DataFrame) -> DataFrame:
    """``cluster_id, idx, val``: the weights of each text's vector that are not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            struct = batch.column(1)
            lists = [struct.field(i) for i in (2, 3)]  # indices and values
            if not struct.null_count and not lists[0].null_count and (lists[1].flatten().to_numpy() != 0).all():  # sparse, and nothing to leave out
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["cluster_id", "idx", "val"])
                continue
            idx, val = [], []
            for v in batch.column(1).to_pylist():
                places = v["indices"] if v["indices"] is not None else range(len(v["values"]))
                some = [(i, x) for i, x in zip(places, v["values"]) if x]
                idx.append([i for i, _ in some])
                val.append([x for _, x in some])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float64()))], ["cluster_id", "idx", "val"]
            )

    return vectors.select(F.col("cluster_id").cast("int"), "tfidf").mapInArrow(run, "cluster_id int, idx array<int>, val array<double>")


def primary_topics(
    vectors: DataFrame, space: TfidfSpace, max_topics: int = MAX_TOPICS
) -> DataFrame:
    """Main and related topics of each cluster, on weight vectors of one global fit.

    ``vectors`` has ``id``, ``cluster_id`` and ``tfidf``. A cluster gets as many
    topics as ``max_topics`` and its size allow.
    """
    entries = materialize(_entries(vectors), "topic-entries")
    sizes = entries.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a cluster
    found = fit_topics(entries, [Cluster(r["cluster_id"], min(max_topics, r["n"]), space.terms) for r in sizes])
    rows = [(c, *_split(rank_topics(weighted_topics(sums, space.terms)))) for c, sums in found.items()]
    return vectors.sparkSession.createDataFrame(rows, TOPICS_SCHEMA)


def _split(ranked: list[str]) -> tuple[str, list[str]]:
    return ranked[0], ranked[1:]


def cluster_topics(
    articles: DataFrame, content: str = "content", topics: int = TOPICS, size: int = VOCABULARY
) -> DataFrame:
    """``(cluster_id, topics)``: each cluster with its own terms, topics joined by " | ".

    ``articles`` has ``id``, ``cluster_id`` and ``content``; '' for a cluster without terms.
    """
    articles = articles.select("id", F.col("cluster_id").cast("int").alias("cluster_id"), content)
    given = [r["cluster_id"] for r in articles.select("cluster_id").distinct().collect()]  # one row a cluster
    vocab, entries = group_vectors(articles, "cluster_id", content, size)
    terms: dict[int, list[str]] = {}
    for r in vocab.select("cluster_id", "term", "idx").orderBy("cluster_id", "idx").collect():  # clusters x size
        terms.setdefault(r["cluster_id"], []).append(r["term"])
    found = fit_topics(entries, [Cluster(c, topics, own) for c, own in terms.items()]) if terms else {}
    texts = {c: " | ".join(t for _, t in weighted_topics(sums, terms[c])) for c, sums in found.items()}
    return articles.sparkSession.createDataFrame([(c, texts.get(c, "")) for c in given], "cluster_id int, topics string")
