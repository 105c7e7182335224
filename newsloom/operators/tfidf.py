"""TF-IDF over words and word pairs, and keyword labels made from it.

Terms are the content words of a text and their neighbouring pairs. The
vocabulary is the most frequent terms, of each group or of all texts. The weight
of a term is tf * (ln((1 + n) / (1 + df)) + 1), and each text's weights are
scaled to unit length. Groups are ranked by mean weight over all their texts.

Most word pairs are rare and would fill a shuffle for nothing. So a first pass counts
the words, and word pairs by ``BUCKETS`` hashed buckets. As many words as the vocabulary
holds, if a group has them, occur at least ``least`` times; a pair whose bucket counts
less cannot be in it. A second pass counts the others, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.once import with_once
from newsloom.functions.stopwords import STOP_WORDS
from newsloom.functions.text import content_tokens, with_bigrams
from newsloom.operators.topk import top_k_per_group
from newsloom.session import broadcast_if_small, fits_in_broadcast, materialize

# Fixed values.
GROUP_VOCABULARY = 50
VOCABULARY = 5000
KEYWORDS = 3

#: Buckets of word pairs, and how many travel in one row.
BUCKETS, BLOCK = 1 << 20, 1 << 16

LARGEST_TERM_FIRST = F.desc  # ties go to the term that sorts last


def with_terms(
    df: DataFrame, content: str = "content", stop_words: Iterable[str] = STOP_WORDS
) -> DataFrame:
    # Two steps, so that the tokens are made once and not once per use.
    tokenized = df.withColumn("_tokens", content_tokens(F.col(content), stop_words))
    return with_once(tokenized, terms=with_bigrams(F.col("_tokens"))).drop("_tokens")


def _tokens_of(docs: DataFrame, *group: str) -> DataFrame:
    """``(*group, tokens)`` of rows with the ``terms`` of ``with_terms``: the words stand before the pairs."""
    words = F.floor((F.size("terms") + 1) / 2).cast("int")
    return docs.select(*group, F.slice("terms", F.lit(1), F.greatest(words, F.lit(0))).alias("tokens"))


class _Words:
    """The words of a batch of texts: a number for each occurrence and for its text."""

    def __init__(self, tokens: pa.Array):
        encoded = tokens.flatten().dictionary_encode()
        self.dictionary = encoded.dictionary
        self.words = encoded.dictionary.to_pylist()
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.rows = np.repeat(np.arange(len(tokens)), lengths)

    def pairs(self) -> np.ndarray:
        """The places of words that have a neighbour after them."""
        return np.flatnonzero(self.rows[1:] == self.rows[:-1])

    def buckets(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The bucket of the pairs at ``at``; ``group`` holds the group's hash for each text."""
        hashes = np.asarray([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        mixed = (hashes[self.codes[at]] * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[self.codes[at + 1]]
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ group.view(np.uint64)[self.rows[at]]) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def _occurrences(group: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each group and key: the group, the key, its occurrences, and the rows that have it."""
    n, span = max(1, len(group)), int(keys.max(initial=0)) + 1
    if span * n * n >= 1 << 62:  # groups of a batch are no more than its rows
        names, keys = np.unique(keys, return_inverse=True)
        g, k, ctf, df = _occurrences(group, rows, keys)
        return g, names[k], ctf, df
    both = np.sort((group[rows] * span + keys) * n + rows)
    own = both // n
    cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    texts = np.cumsum(np.r_[True, both[1:] != both[:-1]][: len(both)])
    ctf = np.diff(np.r_[cut, len(own)])
    df = np.diff(np.r_[texts[cut], texts[-1] + 1]) if len(cut) else cut
    return *np.divmod(own[cut], span), ctf, df


def _numbered(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different values of a column, null among them, and the place of each row's."""
    encoded = column.dictionary_encode(null_encoding="encode")
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _words_and_buckets(docs: DataFrame) -> DataFrame:
    """``(grp, term, ctf, df)`` of words, summed by batch, and ``(block, counts)`` of buckets, summed by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(BUCKETS, np.int64), pa.null()
        for batch in batches:
            kind = batch.column(0).type
            found = _Words(batch.column(2))
            groups, group = _numbered(batch.column(0))
            g, k, ctf, df = _occurrences(group, found.rows, found.codes)
            counts += np.bincount(found.buckets(found.pairs(), batch.column(1).to_numpy()), minlength=BUCKETS)
            n = len(k)
            yield pa.RecordBatch.from_arrays(
                [
                    groups.take(pa.array(g)), found.dictionary.take(pa.array(k)), pa.array(ctf, pa.int64()), pa.array(df, pa.int64()),
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                ],
                names,
            )
        blocks = counts.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        n = len(some)
        if not n:
            return
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(n, kind), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                pa.array(some, pa.int32()), pa.array([blocks[i].astype("<i8").tobytes() for i in some], pa.binary()),
            ],
            names,
        )

    names = ["grp", "term", "ctf", "df", "block", "counts"]
    schema = T.StructType().add("grp", docs.schema["grp"].dataType).add("term", "string").add("ctf", "long").add("df", "long").add("block", "integer").add("counts", "binary")
    return docs.select("grp", F.xxhash64("grp"), "tokens").mapInArrow(run, schema)


def _bucket_counts(parts: DataFrame) -> np.ndarray:
    """The sums of the blocks of all tasks: ``BUCKETS`` numbers, whatever the number of texts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[block] = held.get(block, 0) + np.frombuffer(counts, "<i8")
        # A vocabulary's least count is far below this; 4 bytes a bucket go to the tasks.
        cut = [np.minimum(counts, np.iinfo(np.int32).max).astype("<i4").tobytes() for counts in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(cut, pa.binary())], ["block", "counts"])

    total = np.zeros(BUCKETS, np.int32)
    for row in parts.repartition("block").mapInArrow(add, "block int, counts binary").collect():
        total[row["block"] * BLOCK :][:BLOCK] = np.frombuffer(row["counts"], "<i4")
    return total


def _pair_counts(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """``(grp, term, ctf, df)`` of the word pairs whose bucket counts at least the ``least`` of their row."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _Words(batch.column(3))
            groups, group = _numbered(batch.column(0))
            at = found.pairs()
            least = batch.column(2).to_numpy()[found.rows[at]]
            at = at[shared.value[found.buckets(at, batch.column(1).to_numpy())] >= least]
            g, k, ctf, df = _occurrences(group, found.rows[at], found.codes[at] * len(found.words) + found.codes[at + 1])
            terms = [f"{found.words[a]} {found.words[b]}" for a, b in zip(*(x.tolist() for x in np.divmod(k, max(1, len(found.words)))))]
            yield pa.RecordBatch.from_arrays(
                [groups.take(pa.array(g)), pa.array(terms, pa.string()), pa.array(ctf, pa.int64()), pa.array(df, pa.int64())], ["grp", "term", "ctf", "df"]
            )

    schema = T.StructType().add("grp", docs.schema["grp"].dataType).add("term", "string").add("ctf", "long").add("df", "long")
    return docs.select("grp", F.xxhash64("grp"), "least", "tokens").mapInArrow(run, schema)


def _frequent_terms(docs: DataFrame, group: str | None, size: int) -> DataFrame:
    """``(grp, term, ctf, df)``: occurrences, and texts that have the term, of all words and
    of every pair that may be among the ``size`` most frequent terms of its group.

    ``docs`` has ``tokens`` and the group, if there is one.
    """
    docs = docs.select((F.col(group) if group else F.lit(0).cast("int")).alias("grp"), "tokens")
    parts = materialize(_words_and_buckets(docs), "term-parts")
    words = parts.where("term IS NOT NULL").groupBy("grp", "term").agg(F.sum("ctf").alias("ctf"), F.sum("df").alias("df"))
    words = materialize(words, "word-counts")
    # The size-th count of a group's words is no more than that of its terms.
    order = [F.desc("ctf"), F.asc("term")]
    if group:
        last = top_k_per_group(words.select("grp", "term", "ctf"), ["grp"], order, size, spread=["term"]).where(F.col("rank") == size)
    else:
        last = words.orderBy(*order).limit(size).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("ctf").alias("ctf")).where(F.col("n") == size)
    least = materialize(last.select(F.col("grp").alias("own"), F.col("ctf").alias("least")), "least-counts")
    few = broadcast_if_small(least)
    words = words.join(few, F.col("grp").eqNullSafe(F.col("own")), "left").where("least IS NULL OR ctf >= least").drop("own", "least")
    met = docs.join(few, F.col("grp").eqNullSafe(F.col("own")), "left")
    limited = met.select("grp", F.least(F.coalesce("least", F.lit(0)), F.lit(2**31 - 1)).cast("long").alias("least"), "tokens")
    pairs = _pair_counts(limited, _bucket_counts(parts.where("block IS NOT NULL").select("block", "counts")))
    return words.unionByName(pairs.groupBy("grp", "term").agg(F.sum("ctf").alias("ctf"), F.sum("df").alias("df")))


def idf(n, df):
    return F.log((1 + n) / (1 + df)) + 1


def _group_vocabulary(tokens: DataFrame, group: str, size: int) -> DataFrame:
    order = [F.desc("ctf"), F.asc("term")]
    counts = _frequent_terms(tokens, group, size).withColumnRenamed("grp", group)
    return top_k_per_group(counts, [group], order, size, spread=["term"]).drop("rank")


def group_vocabulary(docs: DataFrame, group: str, size: int = GROUP_VOCABULARY) -> DataFrame:
    """``(group, term, ctf, df)`` of the ``size`` most frequent terms of each group; ``docs`` has ``terms``."""
    return _group_vocabulary(_tokens_of(docs, group), group, size)


def _vocabulary(tokens: DataFrame, size: int) -> DataFrame:
    counts = _frequent_terms(tokens, None, size).drop("grp")
    return counts.orderBy(F.desc("ctf"), F.asc("term")).limit(size)


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """``(term, ctf, df)`` of the ``size`` most frequent terms of all texts; ``docs`` has ``terms``."""
    return _vocabulary(_tokens_of(docs), size)


class _Places:
    """Where the terms of one vocabulary stand in it: words, and pairs by the places of their words."""

    def __init__(self, terms: list[tuple[str, int]]):
        self.words = {term: idx for term, idx in terms if " " not in term}
        pairs = [(*term.split(" "), idx) for term, idx in terms if " " in term]
        self.left = {w: i for i, w in enumerate(sorted({a for a, _, _ in pairs}))}
        self.right = {w: i for i, w in enumerate(sorted({b for _, b, _ in pairs}))}
        keyed = sorted((self.left[a] * len(self.right) + self.right[b], idx) for a, b, idx in pairs)
        self.keys = np.asarray([k for k, _ in keyed], np.int64)
        self.idx = np.asarray([i for _, i in keyed], np.int64)

    def find(self, found: _Words, at: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts and vocabulary places of the words at ``at`` and the pairs at ``pairs``."""
        used = np.unique(found.codes[at])
        names = [found.words[c] for c in used.tolist()]

        def numbers(table: dict[str, int]) -> np.ndarray:
            out = np.full(len(found.words), -1)
            out[used] = [table.get(w, -1) for w in names]
            return out

        single = numbers(self.words)[found.codes[at]]
        rows, idx = [found.rows[at][single >= 0]], [single[single >= 0]]
        if len(self.keys) and len(pairs):
            a, b = numbers(self.left)[found.codes[pairs]], numbers(self.right)[found.codes[pairs + 1]]
            both = (a >= 0) & (b >= 0)
            key = (a * len(self.right) + b)[both]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            rows.append(found.rows[pairs][both][hit])
            idx.append(self.idx[place][hit])
        return np.concatenate(rows), np.concatenate(idx)


def _vocabulary_places(docs: DataFrame, group: str, vocab: DataFrame) -> DataFrame:
    """``(id, group, idx array)`` of texts (id, group, tokens): the place of each occurrence of a vocabulary term.

    ``vocab`` is small enough for every task to hold it.
    """
    terms: dict[object, list[tuple[str, int]]] = {}
    for row in vocab.select(group, "term", "idx").collect():
        terms.setdefault(row[0], []).append((row[1], row[2]))
    shared = docs.sparkSession.sparkContext.broadcast({g: _Places(own) for g, own in terms.items() if g is not None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _Words(batch.column(2))
            groups, group = _numbered(batch.column(1))
            pairs = found.pairs()
            rows, idx = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            of, of_pairs = group[found.rows], group[found.rows[pairs]]
            by, by_pairs = np.argsort(of, kind="stable"), np.argsort(of_pairs, kind="stable")
            edges, pair_edges = (np.searchsorted(x, np.arange(len(groups) + 1)) for x in (of[by], of_pairs[by_pairs]))
            for i, name in enumerate(groups.to_pylist()):
                if name in shared.value:
                    r, x = shared.value[name].find(found, by[edges[i] : edges[i + 1]], pairs[by_pairs[pair_edges[i] : pair_edges[i + 1]]])
                    rows.append(r)
                    idx.append(x)
            row, place = np.concatenate(rows), np.concatenate(idx)
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32()))
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names)
            yield made.filter(pa.array(np.diff(ends) > 0))

    names = ["id", group, "idx"]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in names[:2]]).add("idx", T.ArrayType(T.IntegerType()))
    return docs.select("id", group, "tokens").mapInArrow(run, schema)


def _unit_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The group, distinct places and unit weights of each text, from its places and the idf of each."""
    for batch in batches:
        lists, idfs = batch.column(1), batch.column(2)
        lengths = lists.value_lengths().to_numpy()
        rows, idx, own = np.repeat(np.arange(batch.num_rows), lengths), lists.flatten().to_numpy(), idfs.flatten().to_numpy()
        order = np.lexsort((idx, rows))
        r, i = rows[order], idx[order]
        cut = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (i[1:] != i[:-1])][: len(r)])
        w = np.diff(np.r_[cut, len(r)]) * own[order][cut]
        length = np.sqrt(np.bincount(r[cut], w * w, batch.num_rows))
        ends = pa.array(np.searchsorted(r[cut], np.arange(batch.num_rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(i[cut], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(w / length[r[cut]]))],
            [batch.schema.names[0], "idx", "val"],
        )


def group_vectors(
    articles: DataFrame, group: str, content: str = "content", size: int = GROUP_VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """``(group, term, idx, idf)`` of each group's vocabulary, ``idx`` by the order of the
    terms, and per text ``group, idx, val``: its unit weights by ``idx``.

    Only the places of vocabulary terms leave the scan, one row a text; they are shuffled
    once, as rows of one id and group are one text.
    """
    sizes = articles.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    docs = articles.select("id", group, content_tokens(F.col(content)).alias("tokens"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("term")) - 1  # of at most `size` terms
    vocab = (
        _group_vocabulary(docs, group, size)
        .join(sizes, group)
        .select(group, "term", place.alias("idx"), idf(F.col("n"), F.col("df")).alias("idf"))
    )
    vocab = materialize(vocab, "vocabulary")
    if fits_in_broadcast(vocab):
        hits = _vocabulary_places(docs, group, vocab)
        places = F.flatten(F.collect_list("idx"))
    else:
        terms = with_terms(articles, content).select("id", group, F.explode("terms").alias("term"))
        hits = terms.join(vocab, [group, "term"])
        places = F.collect_list("idx")
    per_doc = hits.groupBy("id", group).agg(places.alias("idx"))
    weights = vocab.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("idx", "idf"))).alias("of"))  # at most `size` terms
    weights = weights.select(group, F.transform("of", lambda x: x["idf"]).alias("of"))
    known = per_doc.join(broadcast_if_small(weights), group).select(group, "idx", F.transform("idx", lambda i: F.get("of", i)).alias("idfs"))
    schema = T.StructType().add(group, articles.schema[group].dataType).add("idx", T.ArrayType(T.IntegerType())).add("val", T.ArrayType(T.DoubleType()))
    return vocab, materialize(known.mapInArrow(_unit_weights, schema), "group-vectors")


def group_weights(
    articles: DataFrame, group: str, content: str = "content", size: int = GROUP_VOCABULARY
) -> DataFrame:
    """``(group, term, mean)``: mean weight per term, each group fitted alone.

    ``articles`` has ``id``, ``group`` and ``content``.
    """
    sizes = articles.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    vocab, vectors = group_vectors(articles, group, content, size)
    unit = vectors.select(group, F.explode(F.arrays_zip("idx", "val")).alias("x")).select(group, "x.idx", "x.val")
    return (
        unit.groupBy(group, "idx").agg(F.sum("val").alias("total"))
        .join(vocab.select(group, "idx", "term"), [group, "idx"]).join(sizes, group)
        .select(group, "term", (F.col("total") / F.col("n")).alias("mean"))
    )


def top_keywords(weights: DataFrame, group: str, k: int = KEYWORDS) -> DataFrame:
    """``(group, rank, term)``: highest mean first; means are compared to 9 places."""
    order = [F.round("mean", 9).desc(), LARGEST_TERM_FIRST("term")]
    return top_k_per_group(weights, [group], order, k).select(group, "rank", "term")


def join_keywords(ranked: DataFrame, group: str, out: str) -> DataFrame:
    """The ranked terms of each group as one text."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "term")))  # at most k per group
    return ranked.groupBy(group).agg(
        F.array_join(F.transform(listed, lambda x: x["term"]), ", ").alias(out)
    )


def cluster_keywords(
    articles: DataFrame, group: str = "cluster_id", content: str = "content",
    size: int = GROUP_VOCABULARY, k: int = KEYWORDS,
) -> DataFrame:
    """``(group, keywords)`` with a vocabulary and idf per group; '' if a group has no terms."""
    weights = group_weights(articles, group, content, size)
    labels = join_keywords(top_keywords(weights, group, k), group, "keywords")
    return (
        articles.select(group).distinct()
        .join(labels, group, "left")
        .withColumn("keywords", F.coalesce("keywords", F.lit("")))
    )


class TfidfSpace:
    """One vocabulary for all texts, and their weight vectors.

    The vocabulary is bounded by ``size``, so it may sit on the driver. Vectors
    are made by JVM transformers inside each row; no shuffle is needed.
    """

    def __init__(self, articles: DataFrame, content: str = "content", size: int = VOCABULARY):
        self.content = content
        self.n = articles.count()
        rows = _vocabulary(articles.select(content_tokens(F.col(content)).alias("tokens")), size).collect()
        # Terms in sorted order: a higher index is a later term, as ties need.
        rows.sort(key=lambda r: r["term"].encode())
        self.terms = [r["term"] for r in rows]
        self.idf = [math.log((1 + self.n) / (1 + r["df"])) + 1 for r in rows]
        self._stages = []
        if self.terms:
            self._stages = [
                CountVectorizerModel.from_vocabulary(self.terms, inputCol="terms", outputCol="_tf"),
                ElementwiseProduct(
                    scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_tfidf"
                ),
                Normalizer(p=2.0, inputCol="_tfidf", outputCol="tfidf"),
            ]

    def transform(self, articles: DataFrame) -> DataFrame:
        """Add the unit weight vector ``tfidf``; needs a non-empty vocabulary."""
        docs = with_terms(articles, self.content)
        for stage in self._stages:
            docs = stage.transform(docs)
        return docs.drop("terms", "_tf", "_tfidf")

    def mean_weights(self, vectors: DataFrame, group: str) -> DataFrame:
        """``(group, term, mean)``, terms a group lacks included with mean 0."""
        means = vectors.groupBy(group).agg(Summarizer.mean(F.col("tfidf")).alias("m"))
        terms = vectors.sparkSession.createDataFrame(
            list(enumerate(self.terms)), "i int, term string"
        )
        return (
            means.select(group, F.posexplode(vector_to_array("m")).alias("i", "mean"))
            .join(F.broadcast(terms), "i")
            .select(group, "term", "mean")
        )

    def labels(self, vectors: DataFrame, group: str, k: int = KEYWORDS) -> DataFrame:
        ranked = top_keywords(self.mean_weights(vectors, group), group, k)
        return join_keywords(ranked, group, "cluster_label")


def global_labels(
    articles: DataFrame, group: str = "cluster_id", content: str = "content",
    size: int = VOCABULARY, k: int = KEYWORDS,
) -> DataFrame:
    """``(group, cluster_label)`` with one vocabulary and idf for all groups."""
    space = TfidfSpace(articles, content, size)
    if not space.terms:
        return articles.select(group).distinct().withColumn("cluster_label", F.lit(""))
    return space.labels(space.transform(articles), group, k)
