"""Fits, needles, streams and similar topics against plain loops."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from newsloom.models import embed_with
from newsloom.operators import cluster as C
from newsloom.operators import kmeans as K
from newsloom.operators import similar, topics
from newsloom.operators.embed import bucket, embed
from newsloom.operators.needles import matches, with_contains
from newsloom.operators.silhouette import mean_silhouettes_squared
from newsloom.plans.stream import harvest_stream, seen_urls


def points(spark, vectors):
    rows = [(i, [float(x) for x in v] if v is not None else None) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    return df.withColumn("features", F.when(F.col("vec").isNotNull(), array_to_vector(F.coalesce("vec", F.array(F.lit(0.0))))))


def plain_kmeans(vectors, ks, most, seed=C.SEED):
    """Step by step, in whole numbers as the library has them."""
    v = np.asarray(vectors, float)
    unit = 2.0 ** (K.BITS - math.frexp(np.abs(v).max())[1])
    x = np.floor(v * unit + 0.5)

    def u(i, salt):
        return (int(hashlib.md5(f"{seed}:{salt}:{i}".encode()).hexdigest()[:13], 16) + 1) / 2.0**52

    def d2(a, b):
        return float(((a - b) ** 2).sum())

    chosen = [min(range(len(x)), key=lambda i: (u(i, "first"), i))]
    for r in range(K.SEED_ROUNDS):
        away = [min(d2(p, x[c]) for c in chosen) for p in x]
        order = sorted((-math.log(u(i, f"round{r}")) / a, i) for i, a in enumerate(away) if a > 0)
        chosen += [i for _, i in order[: K.OVERSAMPLING * most]]
    chosen.sort()
    weight = Counter(min(chosen, key=lambda c: (d2(p, x[c]), c)) for p in x)
    picked = []
    for j in range(most):
        pull = {c: weight[c] * (min(d2(x[c], x[p]) for p in picked) if picked else 1) for c in chosen}
        left = [c for c in chosen if pull[c] > 0]
        if not left:
            break
        picked.append(min(left, key=lambda c: (-math.log(u(c, f"pick{j}")) / pull[c], c)))
    out = {}
    for k in ks:
        centres = [x[c] for c in picked[:k]]
        for _ in range(K.ROUNDS):
            own = [min(range(len(centres)), key=lambda j: (d2(p, centres[j]), j)) for p in x]
            moved = [x[[i for i, o in enumerate(own) if o == j]].mean(axis=0) if j in own else centres[j] for j in range(len(centres))]
            if all((a == b).all() for a, b in zip(moved, centres)):
                break
            centres = moved
        numbers = {}
        for o in own:
            numbers.setdefault(o, len(numbers))
        out[k] = [numbers[o] for o in own]
    return out


def test_kmeans_step_by_step(spark):
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.normal(c, 0.6, size=(25, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 4, 0), (0, 0, 4))])
    vectors[70:80] = vectors[0]
    df = points(spark, vectors.tolist()).repartition(3)
    for k in (2, 4, 7):
        got = [r["cluster_id"] for r in C.kmeans(df, k).assign(df).orderBy("id").collect()]
        assert got == plain_kmeans(vectors, [k], k)[k]
    fitted = C.choose_k(df)
    got = [r["cluster_id"] for r in fitted.assign(df).orderBy("id").collect()]
    assert got == plain_kmeans(vectors, [fitted.k], C.MAX_CLUSTERS)[fitted.k]


def test_kmeans_odd_inputs(spark):
    df = points(spark, [[1, 1], None, [1, 1], [1, 1]])
    fitted = C.kmeans(df, 3)  # one point, three times
    assert len(fitted.centres) == 1 and {r["cluster_id"] for r in fitted.assign(df.where("vec IS NOT NULL")).collect()} == {0}
    two = points(spark, [[0, 0], None, [5, 5], [0, 0], [5, 5]])
    assert [r["cluster_id"] for r in C.kmeans(two, 2).assign(two).orderBy("id").collect()] == [0, None, 1, 0, 1]
    zero = points(spark, [[0, 0], [0, 0]])
    assert {r["cluster_id"] for r in C.kmeans(zero, 2).assign(zero).collect()} == {0}


def test_sums_of_several_labelings(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(40, 3))
    labels = rng.integers(0, 4, size=(40, 2))
    rows = [(i, v.tolist(), int(a), int(b) if i % 5 else None) for i, (v, (a, b)) in enumerate(zip(vectors, labels))]
    df = spark.createDataFrame(rows, "id long, vec array<double>, a int, b int").withColumn("features", array_to_vector("vec"))
    got = dict(mean_silhouettes_squared(df, "features", ["a", "b"]))

    def plain(keep, own):
        v, own = vectors[keep], own[keep]
        d = ((v[:, None] - v[None]) ** 2).sum(-1)
        out = []
        for i in range(len(v)):
            mine = own == own[i]
            if mine.sum() == 1:
                out.append(0.0)
                continue
            a = d[i, mine].sum() / (mine.sum() - 1)
            b = min(d[i, own == c].mean() for c in set(own.tolist()) - {own[i]})
            out.append((b - a) / max(a, b))
        return float(np.mean(out))

    assert got[0] == pytest.approx(plain(np.arange(40), labels[:, 0]), abs=1e-12)
    assert got[1] == pytest.approx(plain(np.flatnonzero(np.arange(40) % 5), labels[:, 1]), abs=1e-12)


def plain_topics(docs, terms, k, rounds, seed=C.SEED):
    """docs: lists of (place, weight)."""
    v = len(terms)
    whole = np.zeros(v)
    for doc in docs:
        for i, w in doc:
            whole[i] += w
    n = np.asarray([[whole[i] * topics.start(t, j, seed) / k for j in range(k)] for i, t in enumerate(terms)])
    for _ in range(rounds):
        b = (n + 1 / k) / (n.sum(axis=0) + v / k)
        n = np.zeros((v, k))
        for doc in docs:
            share = sum((w * b[i] / b[i].sum() for i, w in doc), np.zeros(k)) + 1 / k
            for i, w in doc:
                n[i] += w * b[i] * share / (b[i] * share).sum()
    return n


def test_topics_of_all_clusters_equal_fits_one_by_one(spark, monkeypatch):
    rng = random.Random(1)
    names = {c: sorted(f"t{c}{i}" for i in range(size)) for c, size in ((0, 6), (4, 9), (7, 3))}
    docs = [(c, [(i, rng.random()) for i in sorted(rng.sample(range(len(names[c])), rng.randint(0, len(names[c]))))]) for c in names for _ in range(8)]
    rows = spark.createDataFrame([(c, [i for i, _ in d], [w for _, w in d]) for c, d in docs], "cluster_id int, idx array<int>, val array<double>").repartition(3)
    clusters = [topics.Cluster(c, k, names[c]) for c, k in ((0, 2), (4, 3), (7, 1))]
    for model in (topics.MODEL, 20):  # together, and in lots
        monkeypatch.setattr(topics, "MODEL", model)
        found = topics.fit_topics(rows, clusters, rounds=4)
        for c, k, terms in clusters:
            want = plain_topics([d for own, d in docs if own == c], terms, k, 4)
            assert np.abs(found[c] - want).max() < 1e-12
    assert topics.top_terms(np.asarray([1.0, 3.0, 1.0]), ["a", "b", "c"]) == "b, c, a"


def test_sketch(spark):
    texts = ["Bank bank rates", "rates of rain", "", None, "the of"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = {r["id"]: r["features"].toArray() for r in embed(df, dimensions=16).collect()}
    words = [["bank", "bank", "rates"], ["rates", "rain"], [], [], []]
    raw = np.zeros((5, 16))
    for i, own in enumerate(words):
        for w in own:
            b, sign = bucket(w, 16)
            raw[i, b] += sign
    weighted = raw * np.log(6 / ((raw != 0).sum(axis=0) + 1))
    for i in range(5):
        length = np.linalg.norm(weighted[i])
        assert np.allclose(got[i], weighted[i] / length if length else 0.0, atol=1e-15)


def test_needles(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd.é漢") for _ in range(rng.randint(0, 25))) for _ in range(120)] + [None, "", "abc", "abc"]
    needles = ["".join(rng.choice("abcd.é漢") for _ in range(rng.randint(1, 6))) for _ in range(80)] + [None, "", "abc", "abc", "no such", "a", "bc"]
    rows = spark.createDataFrame([(i, t, "n", "g") for i, t in enumerate(texts)], "id long, url string, needle string, gram string").repartition(3)
    table = spark.createDataFrame([(n, "x") for n in needles], "word string, text string")
    got = {tuple(r) for r in matches(rows, "url", table, "word").collect()}
    want = {(t, n) for t in texts if t for n in needles if n and n in t}
    assert got == want
    flags = {r["id"]: r["hit"] for r in with_contains(rows, "url", table, "word", "hit").collect()}
    assert flags == {i: any(n in t for n in needles if n) if t else False for i, t in enumerate(texts)}
    none = with_contains(rows, "url", table.where("false"), "word", "hit")
    assert none.columns == [*rows.columns, "hit"] and not any(r["hit"] for r in none.collect()) and none.count() == len(texts)
    assert matches(rows.where("false"), "url", table, "word").count() == 0


def test_stream_takes_each_url_once_and_may_repeat_a_batch(spark, tmp_path):
    landing, folder, checkpoint = (str(tmp_path / n) for n in ("landing", "seen", "checkpoint"))
    good = "https://site.org/{}"

    def land(rows):
        spark.createDataFrame(rows, "pos long, url string").coalesce(1).write.mode("append").parquet(landing)
        harvest_stream(spark, landing, folder, checkpoint).awaitTermination()
        return sorted((r["url"], r["pos"], r["batch"]) for r in seen_urls(spark, folder).collect())

    first = land([(3, good.format(1)), (1, good.format(1)), (2, "no url"), (4, None), (5, good.format(2))])
    assert first == [(good.format(1), 1, 0), (good.format(2), 5, 0)]
    second = land([(0, good.format(1)), (7, good.format(3)), (8, good.format("premium"))])
    assert second == [*first, (good.format(3), 7, 1)]
    for name in ("1", ".1.crc"):  # as if the run had failed before it was noted
        (tmp_path / "checkpoint" / "commits" / name).rename(tmp_path / f"kept{name}")
    harvest_stream(spark, landing, folder, checkpoint).awaitTermination()
    assert sorted((r["url"], r["pos"], r["batch"]) for r in seen_urls(spark, folder).collect()) == second


def test_similar_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 7)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 4)).tolist()
    vectors[20:40] = [[2 * x for x in vectors[5]]] * 20
    vectors[50] = vectors[55] = [0.0] * 4
    rows = [(d, 100 * i + j, v) for j, (d, size) in enumerate((("a", 60), ("b", 5), (None, 30))) for i, v in enumerate(vectors[:size])]
    df = spark.createDataFrame(rows, "digest string, pos long, vec array<double>")
    for threshold in (-0.2, 0.3, 0.75):
        got = sorted(r["pos"] // 100 for r in similar.filter_similar(df, threshold=threshold).where("digest = 'a'").collect())
        unit = [np.array(v) / (np.linalg.norm(v) or 1) for v in vectors]
        kept = []
        for i, u in enumerate(unit):
            if all(float(u @ unit[j]) < threshold for j in kept):
                kept.append(i)
        assert got == kept


def test_one_bad_text_costs_one_vector(spark):
    df = spark.createDataFrame([(0, "good"), (1, "bad"), (2, None)], "pos long, content string").withColumn("error", F.lit("before"))

    def model(texts):
        if "bad" in texts:
            raise ValueError("boom")
        return [[len(t), 1.0] for t in texts]

    rows = {r["pos"]: r for r in embed_with(df, lambda: model).collect()}
    assert rows[0]["features"].toArray().tolist() == [4.0, 1.0] and rows[2]["features"].toArray().tolist() == [0.0, 1.0]
    assert rows[1]["features"] is None and rows[1]["error"] == "before; boom" and rows[0]["error"] == "before"
