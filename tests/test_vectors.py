"""Clustering, silhouette, similar topics, TF-IDF and digests against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from newsloom.functions.stopwords import STOP_WORDS
from newsloom.models import embed_with, score_with, summarize_with
from newsloom.operators import cluster as C
from newsloom.operators import silhouette as S
from newsloom.operators import similar, tfidf
from newsloom.operators.similar import filter_similar, filter_similar_topics
from newsloom.operators.tfidf import TfidfSpace, cluster_keywords, global_labels
from newsloom.operators.topics import cluster_topics, rank_topics
from newsloom.plans import digest as D
from newsloom.plans.enrich import enrich_files, summarize_by_chunks
from newsloom.session import materialize


def points(spark, vectors, labels=None):
    rows = [(i, [float(x) for x in v], labels[i] if labels is not None else 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, cluster_id int")
    return df.withColumn("features", array_to_vector("vec"))


def plain_silhouette(vectors, labels):
    v, labels = np.asarray(vectors, float), np.asarray(labels)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    scores = []
    for i in range(len(v)):
        own = labels == labels[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels.tolist()) - {labels[i]})
        scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(scores))


def test_silhouette_in_blocks(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(90, 5))
    vectors[30:60] = vectors[0]  # a third are copies
    vectors[60] = vectors[0] + 1e-7
    labels = [int(x) for x in rng.integers(0, 4, 89)] + [9]
    df = points(spark, vectors, labels).select("id", "vec", F.array("cluster_id").alias("labels"))
    got = S.mean_silhouettes(df, 90, block=16).first()["silhouette"]
    assert got == pytest.approx(plain_silhouette(vectors, labels), abs=1e-9)


def test_silhouette_shuffles_no_copies_of_the_points(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 4))
    vectors[100:200] = vectors[:100]
    vectors[250] = vectors[0] + 1e-8  # close to both copies
    labels = [int(x) for x in rng.integers(0, 3, 300)]
    df = points(spark, vectors, labels).select("id", "vec", F.array("cluster_id", F.lit(7) - F.col("cluster_id")).alias("labels"))
    sums = S.distance_sums(df, 300, block=32)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate explode" not in plan
    scores = {r["run"]: r["silhouette"] for r in S.mean_silhouettes(df, 300, block=32).collect()}
    want = plain_silhouette(vectors, labels)
    assert scores == pytest.approx({0: want, 1: want}, abs=1e-9)


def test_silhouette_of_one_cluster_is_null(spark):
    df = points(spark, [[0], [1]], [0, 0]).select("id", "vec", F.array("cluster_id").alias("labels"))
    assert S.mean_silhouettes(df, 2).first()["silhouette"] is None


def test_choose_k(spark):
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.normal(c, 0.05, size=(12, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    df = points(spark, vectors)
    fitted = C.choose_k(df, metric="euclidean")
    assigned = [r["cluster_id"] for r in fitted.assign(df).orderBy("id").collect()]
    assert fitted.k == 3 and assigned == [0] * 12 + [1] * 12 + [2] * 12
    assert fitted.scores[3] == pytest.approx(plain_silhouette(vectors, assigned), abs=1e-9)
    assert sorted(fitted.scores) == list(range(2, 11))


def test_choose_k_small_inputs(spark):
    with pytest.raises(ValueError):
        C.choose_k(points(spark, [[1, 2]]))
    assert C.choose_k(points(spark, [[0, 0], [1, 1]])).k == 2
    assert list(C.choose_k(points(spark, [[0], [1], [9]])).scores) == [2]
    same = C.choose_k(points(spark, [[1, 1]] * 5))
    assert same.k == 2 and not same.scores


def test_choose_k_by_squared_distance(spark):
    vectors = [[0, 0], [0, 1], [9, 9], [9, 8], [0, 0.5]]
    assert C.choose_k(points(spark, vectors), max_clusters=3).k == 2


def test_fits_do_not_depend_on_the_input_partitions(spark):
    vectors = np.random.default_rng(4).normal(size=(4000, 3))
    df = points(spark, vectors).cache()
    found = [
        sorted(tuple(r) for r in C.kmeans(df.repartition(n), 5).assign(df).select("id", "cluster_id").collect())
        for n in (2, 7)
    ]
    assert found[0] == found[1]


def test_best_k_takes_the_smallest_on_a_tie():
    assert C.best_k({3: 0.5, 2: 0.5, 4: 0.1}, 2) == 2 and C.best_k({5: -1.0}, 2) == 2


def test_representatives(spark):
    df = points(spark, [[0, 0], [2, 0], [1, 5], [10, 0], [12, 0]], [0, 0, 0, 1, 1]).withColumn(
        "summary", F.concat(F.lit("s"), "id")
    )
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [12.0, 0.0]), (2, [0.0, 0.0])], "cluster_id int, centroid array<double>")
    got = C.representatives(df, centres).orderBy("cluster_id").collect()
    assert [(r["cluster_id"], r["id"], r["summary"]) for r in got] == [(0, 0, "s0"), (1, 4, "s4")]
    near = C.nearest_centroid(df, centres).orderBy("id").collect()
    assert [r["nearest"] for r in near] == [2, 0, 0, 1, 1]


def plain_filter(vectors, threshold):
    unit = [np.array(v) / (np.linalg.norm(v) or 1) for v in vectors]
    kept = []
    for i, u in enumerate(unit):
        if all(float(u @ unit[j]) < threshold for j in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("threshold", [-0.2, 0.3, 0.75])
def test_filter_similar(spark, threshold):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 4)).tolist()
    vectors[20:40] = [[2 * x for x in vectors[5]]] * 20  # a third point the same way
    vectors[50] = vectors[55] = [0.0] * 4
    df = points(spark, vectors * 2).select((F.col("id") >= 60).alias("digest"), F.col("id").alias("pos"), "vec")
    got = sorted(r["pos"] for r in filter_similar(df, threshold=threshold).collect())
    kept = plain_filter(vectors, threshold)
    assert got == kept + [60 + i for i in kept]


def test_filter_similar_chain_and_equality(spark):
    a = [(0, [1.0, 0.0]), (1, [1.0, 0.9]), (2, [0.0, 1.0])]  # A~B~C, A not ~C
    df = spark.createDataFrame(a, "pos long, vec array<double>").withColumn("digest", F.lit(0))
    assert [r["pos"] for r in filter_similar(df, threshold=0.6).orderBy("pos").collect()] == [0, 2]
    edge = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 4.0])], "pos long, vec array<double>").withColumn("digest", F.lit(0))
    assert [r["pos"] for r in filter_similar(edge, threshold=0.6).collect()] == [0]
    assert filter_similar(df.limit(0)).count() == 0


def test_filter_similar_makes_a_length_once_a_row(spark, monkeypatch):
    seen = []

    def written(df, label, *by):
        seen.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return materialize(df, label, *by)

    monkeypatch.setattr(similar, "materialize", written)
    df = points(spark, [[1.0, 0.0], [3.0, 4.0]]).select(F.lit(0).alias("digest"), F.col("id").alias("pos"), "vec")
    assert [r["pos"] for r in filter_similar(df, threshold=0.6).collect()] == [0]
    assert [plan.count("aggregate(") for label, plan in seen if label == "similar-units"] == [1]


def test_filter_similar_topics(spark):
    topics = [(0, ["bank", "rates"]), (1, ["rates", "bank"]), (2, ["rain"]), (3, ["bank", "rates", "rain", "wind", "fog"])]
    df = spark.createDataFrame(topics, "pos long, keywords array<string>").withColumn("digest", F.lit(0))
    assert [tuple(r)[:2] for r in filter_similar_topics(df).orderBy("pos").collect()] == [topics[0], topics[2], topics[3]]
    assert filter_similar_topics(df.limit(0)).count() == 0


def plain_labels(texts, size, global_fit):
    """texts: {cluster: [text]} -> {cluster: label}, step by step."""
    def terms(text):
        words = [w for w in text.lower().replace(".", " ").split() if len(w) > 1 and w not in STOP_WORDS]
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    groups = {None: [t for ts in texts.values() for t in ts]} if global_fit else texts
    labels = {}
    for cluster, own in texts.items():
        fit = [terms(t) for t in groups[None if global_fit else cluster]]
        counts = Counter(t for ts in fit for t in ts)
        vocab = sorted(counts, key=lambda t: (-counts[t], t))[:size]
        idf = {t: math.log((1 + len(fit)) / (1 + sum(t in ts for ts in fit))) + 1 for t in vocab}
        means = dict.fromkeys(vocab, 0.0)
        for text in own:
            tf = Counter(t for t in terms(text) if t in idf)
            w = {t: n * idf[t] for t, n in tf.items()}
            length = math.sqrt(sum(x * x for x in w.values()))
            for t, x in w.items():
                means[t] += x / length / len(own)
        ranked = sorted(sorted(vocab, reverse=True), key=lambda t: -round(means[t], 9))
        labels[cluster] = ", ".join(ranked[:3])
    return labels


TEXTS = {
    0: ["stocks rally as banks rise.", "banks rise again", "central bank cut rates"],
    1: ["team wins final match", "final match drew crowds", "the of and"],
    2: ["alone alone"],
}


@pytest.mark.parametrize("size", [4, 50])
def test_tfidf(spark, size):
    rows = [(i, c, t) for i, (c, t) in enumerate((c, t) for c, ts in TEXTS.items() for t in ts)]
    docs = spark.createDataFrame(rows, "id long, cluster_id int, content string")
    got = {r["cluster_id"]: r["keywords"] for r in cluster_keywords(docs, size=size).collect()}
    assert got == plain_labels(TEXTS, size, False)
    got = {r["cluster_id"]: r["cluster_label"] for r in global_labels(docs, size=size).collect()}
    assert got == plain_labels(TEXTS, size, True)


def test_only_stop_words(spark):
    docs = spark.createDataFrame([(0, 0, "the of"), (1, 1, "and")], "id long, cluster_id int, content string")
    assert {r["keywords"] for r in cluster_keywords(docs).collect()} == {""}
    assert {r["cluster_label"] for r in global_labels(docs).collect()} == {""}
    assert {r["topics"] for r in cluster_topics(docs).collect()} == {""}
    assert not TfidfSpace(docs).terms


def test_rank_topics():
    assert rank_topics([(1.0, "a"), (2.0, "b"), (1.0, "c")]) == ["b", "c", "a"]


def _news(spark):
    rows = [
        (i, f"{a} {b} report number{i}. {b} grows in {a}.")
        for i, (a, b) in enumerate([("football", "league"), ("bank", "market"), ("rain", "flood")] * 6)
    ]
    return spark.createDataFrame(rows, "pos long, content string")


def test_digest_of_files(spark):
    result = D.digest(files=_news(spark))
    rows = result.articles.orderBy("id").collect()
    assert len(rows) == 18 and len({r["id"] for r in rows}) == 18
    assert {r["title"] for r in rows} == {"Custom File"}
    assert {r["cluster_id"] for r in rows} == set(range(result.k)) and rows[0]["cluster_id"] == 0
    topics = {r["cluster_id"]: r for r in result.topics.collect()}
    assert set(topics) == set(range(result.k))
    assert all(t["primary_focus"] and len(t["related_topics"]) <= 2 for t in topics.values())
    assert {r["cluster_label"] for r in rows} == {t["cluster_label"] for t in topics.values()}


def test_digest_of_little(spark):
    news = _news(spark)
    assert D.digest(files=news.limit(0)) is None and D.digest() is None
    one = D.digest(files=news.limit(1))
    row, topic = one.articles.first(), one.topics.first()
    assert (one.k, row["cluster_id"], topic["related_topics"]) == (1, 0, [])
    assert row["cluster_label"] == topic["primary_focus"] != ""
    two = D.digest(files=news.limit(2))
    assert two.k == 2 and sorted(r["cluster_id"] for r in two.articles.collect()) == [0, 1]


def test_chunk_summaries_join_without_gap(spark):
    text = "Alpha beta. " * 300
    df = spark.createDataFrame([(0, text), (1, " "), (2, "w" * 120)], "id long, content string")
    got = [r["summary"] for r in summarize_by_chunks(df).orderBy("id").collect()]
    three = " ".join(["Alpha beta."] * 3)
    assert got == [three + three, "No input provided.", ""]


def test_model_slots(spark):
    def summarizer():
        def model(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("no model")
            return [t.upper() for t in texts]
        return model

    def scorer():
        return lambda texts: [("POSITIVE" if "GOOD" in t else "NEGATIVE", 0.75) for t in texts]

    df = spark.createDataFrame([(0, "good"), (1, "boom"), (2, " "), (3, None), (4, "bad")], "pos long, content string")
    df = df.repartition(1)
    rows = enrich_files(
        df, summarizer=lambda d: summarize_with(d, summarizer), scorer=lambda d: score_with(d, scorer)
    ).orderBy("pos").collect()
    assert [(r["pos"], r["summary"], r["sentiment"], r["score"]) for r in rows] == [
        (0, "GOOD", "POSITIVE", 0.75), (1, "Error generating summary: no model", "NEGATIVE", 0.75),
        (4, "BAD", "NEGATIVE", 0.75),
    ]
    blank = summarize_with(df.where("pos IN (2, 3)"), summarizer).select("summary", "error").collect()
    assert [tuple(r) for r in blank] == [("No input provided.", None)] * 2
    vectors = embed_with(df.where("pos = 0"), lambda: lambda texts: [[len(t), 1] for t in texts]).first()
    assert vectors["features"].toArray().tolist() == [4.0, 1.0]


def test_model_slots_keep_errors_and_see_no_blanks(spark):
    df = spark.createDataFrame([(0, "good"), (1, " "), (2, None), (3, "bad")], "pos long, content string")

    def summarizer():
        def run(texts):
            assert all(t.strip() for t in texts), "blank"
            if "bad" in texts:
                raise ValueError("boom")
            return [t.upper() for t in texts]
        return run

    rows = score_with(summarize_with(df, summarizer), lambda: lambda texts: [("POSITIVE", 0.5)] * len(texts))
    got = [(r["summary"], r["error"]) for r in rows.orderBy("pos").collect()]
    assert got == [
        ("GOOD", None), ("No input provided.", None), ("No input provided.", None),
        ("Error generating summary: boom", "boom"),
    ]
    short = summarize_with(df.where("pos = 0"), lambda: lambda texts: []).first()
    assert short["error"] == "0 results for 1 texts"


def test_terms_of_rare_pairs_are_left_out_before_the_shuffle_and_counts_stay(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.randrange(60))) for _ in range(200)]
    rows = [(i, (None, "a", "b")[i % 3], text) for i, text in enumerate([*texts, None, "", "w1"])]
    docs = tfidf.with_terms(spark.createDataFrame(rows, "id long, g string, content string"))

    def terms(text):
        own = (text or "").split()
        return own + [f"{a} {b}" for a, b in zip(own, own[1:])]

    def plain(some, size):
        ctf, df = Counter(t for text in some for t in terms(text)), Counter(t for text in some for t in set(terms(text)))
        return [(t, ctf[t], df[t]) for t in sorted(ctf, key=lambda t: (-ctf[t], t))[:size]]

    for size in (40, 2000):  # the second is more than there are words
        got = [tuple(r) for r in tfidf.vocabulary(docs, size).collect()]
        assert sorted(got) == sorted(plain([text for _, _, text in rows], size))
        own = tfidf.group_vocabulary(docs, "g", size).collect()
        for g in (None, "a", "b"):
            assert sorted((r["term"], r["ctf"], r["df"]) for r in own if r["g"] == g) == sorted(plain([t for _, k, t in rows if k == g], size))

    tokens = tfidf._tokens_of(docs, "g")
    sent = tfidf._frequent_terms(tokens, None, 40)
    assert sent.count() < len(Counter(t for _, _, text in rows for t in terms(text))) / 10


def test_group_vectors_hold_the_texts_of_one_id_as_one(spark, monkeypatch):
    rows = [(1, "a", "red fox red fox"), (1, "a", "fox den"), (2, "a", "den"), (2, "b", "red fox"), (None, "b", "red"), (3, None, "red"), (4, "b", None)]
    articles = spark.createDataFrame(rows, "id long, g string, content string")
    results = []
    for small in (True, False):
        monkeypatch.setattr(tfidf, "fits_in_broadcast", lambda vocab: small)
        vocab, vectors = tfidf.group_vectors(articles, "g")
        names = {(r["g"], r["idx"]): (r["term"], r["idf"]) for r in vocab.collect()}
        found = []
        for r in vectors.collect():
            own = [names[r["g"], i] for i in r["idx"]]
            found.append((r["g"], tuple((t, round(v, 12)) for (t, _), v in zip(own, r["val"]))))
            assert sum(v * v for v in r["val"]) == pytest.approx(1)
        results.append(sorted(found))
    assert results[0] == results[1]
    texts = [[t for t, _ in own] for _, own in results[0]]
    assert sorted(texts) == [["den"], ["den", "fox", "fox den", "fox red", "red", "red fox"], ["fox", "red", "red fox"], ["red"]]
