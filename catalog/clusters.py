"""Vectors, clusters and what is read from them, on given clusters."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.common import sql_content_tokens, table
from newsloom.functions.text import content_tokens
from newsloom.functions.vectors import cosine, euclidean
from newsloom.operators.cluster import (
    MAX_CLUSTERS, MIN_CLUSTERS, SEED, array_features, best_k, centroids, choose_k, kmeans,
    nearest_centroid, representatives,
)
from newsloom.operators.embed import DIMENSIONS, embed
from newsloom.operators.silhouette import mean_silhouettes_squared, silhouette
from newsloom.operators.kmeans import BITS, OVERSAMPLING, ROUNDS, SEED_ROUNDS
from newsloom.operators.similar import THRESHOLD, filter_similar, filter_similar_topics
from newsloom.operators.tfidf import VOCABULARY, TfidfSpace
from newsloom.operators.topics import MAX_TOPICS, ROUNDS as TOPIC_ROUNDS, TOPICS, cluster_topics, primary_topics
from newsloom.session import broadcast_if_small, materialize

DIGEST = 30  # topics of a digest: ten clusters with three each
SIMILAR = 0.3  # cosines of the test vectors stay below the default threshold


def _points(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return array_features(rows, "embedding").select(
        F.col("vec_id").alias("id"), "features", F.col("label").alias("cluster_id")
    )


_POINTS_SQL = """
points AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label AS cluster_id FROM embeddings),
dims AS (SELECT cluster_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM points),
means AS (SELECT cluster_id, i, avg(x) AS m FROM dims GROUP BY cluster_id, i),
centres AS (SELECT cluster_id, list(m ORDER BY i) AS c FROM means GROUP BY cluster_id)"""


def cluster_silhouette(spark, sf_dir):
    result = silhouette(_points(spark, sf_dir), metric="euclidean", block=128)
    return result.select("metric", "n", F.round("silhouette", 9).alias("silhouette"))


def cluster_silhouette_squared(spark, sf_dir):
    """The default form, linear in the number of points."""
    result = silhouette(_points(spark, sf_dir))
    return result.select("metric", "n", F.round("silhouette", 9).alias("silhouette"))


def _silhouette_sql(metric, distance):
    return f"""
WITH points AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label AS k FROM embeddings),
sums AS (SELECT a.id, a.k, b.k AS other, sum({distance}) AS total, count(*) AS n
         FROM points a, points b GROUP BY a.id, a.k, b.k),
ab AS (SELECT id, max(n) FILTER (k = other) AS size,
              max(total) FILTER (k = other) AS within, min(total / n) FILTER (k <> other) AS b
       FROM sums GROUP BY id),
s AS (SELECT CASE WHEN size = 1 THEN 0 ELSE (b - within / (size - 1)) / greatest(within / (size - 1), b) END AS s FROM ab)
SELECT '{metric}' AS metric, count(*) AS n, round(avg(s), 9) AS silhouette FROM s"""


def cluster_nearest(spark, sf_dir):
    points = _points(spark, sf_dir)
    near = nearest_centroid(points, centroids(points))
    return near.select("id", "nearest", F.round("distance", 9).alias("distance"))


NEAREST_SQL = f"""
WITH {_POINTS_SQL},
d AS (SELECT id, centres.cluster_id AS nearest, list_distance(v, c) AS distance FROM points, centres)
SELECT id, nearest, round(distance, 9) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, nearest) AS r FROM d) WHERE r = 1"""


def _own_centre(spark, sf_dir):
    points = _points(spark, sf_dir)
    centres = broadcast_if_small(materialize(centroids(points), "centroids"))
    return points.join(centres, "cluster_id").withColumn("v", vector_to_array("features"))


def cosine_to_centroid(spark, sf_dir):
    return _own_centre(spark, sf_dir).select(
        "id", F.round(cosine(F.col("v"), F.col("centroid")), 9).alias("cosine")
    )


def distance_to_centroid(spark, sf_dir):
    return _own_centre(spark, sf_dir).select(
        "id", F.round(euclidean(F.col("v"), F.col("centroid")), 9).alias("distance")
    )


def cluster_representatives(spark, sf_dir):
    """The summary here is the text of the document with the vector's number."""
    points = _points(spark, sf_dir)
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("summary")
    )
    rows = points.join(documents, "id", "left")
    found = representatives(rows, centroids(points))
    return found.select("cluster_id", "id", F.round("distance", 9).alias("distance"), "summary")


REPRESENTATIVES_SQL = f"""
WITH {_POINTS_SQL},
d AS (SELECT cluster_id, id, list_distance(v, c) AS distance FROM points JOIN centres USING (cluster_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY distance, id) AS r FROM d)
SELECT cluster_id, id, round(distance, 9) AS distance, text AS summary
FROM r LEFT JOIN documents ON doc_id = id WHERE r = 1"""


def similar_topics(spark, sf_dir):
    """All vectors, as the topics of digests of ``DIGEST`` rows."""
    rows = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") - F.col("vec_id") % DIGEST).alias("digest"),
        F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"),
    )
    return filter_similar(rows, threshold=SIMILAR).select("digest", "pos")


def similar_in_one(spark, sf_dir):
    """All vectors as the topics of one digest."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.lit(0).alias("digest"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec")
    )
    return filter_similar(rows, threshold=SIMILAR).select("digest", "pos")


def similar_sql(source: str, threshold: float) -> str:
    """CTEs ending in ``kept(digest, pos)`` of ``source(digest, pos, e DOUBLE[])``; needs RECURSIVE."""
    return f"""
v AS MATERIALIZED (SELECT pos, digest, e, row_number() OVER (PARTITION BY digest ORDER BY pos) AS i FROM {source}),
near AS (
  SELECT b.digest, b.pos, list(a.i) AS earlier
  FROM v a JOIN v b ON a.digest = b.digest AND a.i < b.i AND coalesce(list_cosine_similarity(a.e, b.e), 0) >= {threshold}
  GROUP BY b.digest, b.pos),
steps AS MATERIALIZED (SELECT v.digest, v.i, v.pos, coalesce(earlier, []) AS earlier FROM v LEFT JOIN near USING (digest, pos)),
walk AS (
  SELECT digest, CAST(1 AS BIGINT) AS i, [CAST(1 AS BIGINT)] AS kept FROM steps WHERE i = 1
  UNION ALL
  SELECT s.digest, s.i, CASE WHEN list_has_any(kept, earlier) THEN kept ELSE list_append(kept, s.i) END
  FROM walk JOIN steps s ON s.digest = walk.digest AND s.i = walk.i + 1),
last AS (SELECT digest, arg_max(kept, i) AS kept FROM walk GROUP BY digest),
stay AS (SELECT digest, pos FROM v JOIN last USING (digest) WHERE list_contains(kept, i))"""


SIMILAR_SQL = f"""
WITH RECURSIVE rows_ AS (SELECT vec_id - vec_id % {DIGEST} AS digest, vec_id AS pos, embedding::DOUBLE[] AS e FROM embeddings),
{similar_sql('rows_', SIMILAR)} SELECT digest, pos FROM stay"""
SIMILAR_ONE_SQL = f"""
WITH RECURSIVE rows_ AS (SELECT 0 AS digest, vec_id AS pos, embedding::DOUBLE[] AS e FROM embeddings),
{similar_sql('rows_', SIMILAR)} SELECT digest, pos FROM stay"""


# ------------------------------------------------- no SQL for hashing and fits

def _articles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang"
    )


def embed_texts(spark, sf_dir):
    vectors = embed(_articles(spark, sf_dir))
    return vectors.select("id", vector_to_array("features").alias("embedding"))


def embed_components(spark, sf_dir):
    """Every component that is not 0."""
    each = embed_texts(spark, sf_dir).select("id", F.posexplode("embedding").alias("component", "value"))
    return each.where("value != 0").withColumn("value", F.round("value", 9))


def embed_sql(source: str, name: str = "em") -> str:
    """CTEs ending in ``name(id, v DOUBLE[])``: the default vectors of ``source(id, content)``."""
    return f"""
{name}_t AS (SELECT id, md5(unnest({sql_content_tokens("coalesce(content, '')")})) AS m FROM {source}),
{name}_r AS (SELECT id, ('0x' || substr(m, 1, 7))::BIGINT % {DIMENSIONS} AS b, sum(CASE WHEN substr(m, 8, 1) < '8' THEN 1 ELSE -1 END) AS c
  FROM {name}_t GROUP BY id, b HAVING c <> 0),
{name}_i AS (SELECT b, ln(((SELECT count(*) FROM {source}) + 1) / (count(*) + 1)) AS idf FROM {name}_r GROUP BY b),
{name}_x AS MATERIALIZED (SELECT id, b, c * idf AS x FROM {name}_r JOIN {name}_i USING (b)),
{name}_n AS (SELECT id, sqrt(sum(x * x)) AS l FROM {name}_x GROUP BY id),
{name} AS MATERIALIZED (SELECT s.id, list(CASE WHEN l > 0 THEN coalesce(x, 0) / l ELSE 0.0 END ORDER BY d.b) AS v
  FROM {source} s CROSS JOIN range({DIMENSIONS}) AS d(b) LEFT JOIN {name}_n n ON n.id = s.id LEFT JOIN {name}_x x ON x.id = s.id AND x.b = d.b
  GROUP BY s.id)"""


_TEXTS_SQL = "texts AS (SELECT doc_id AS id, text AS content FROM documents)"
EMBED_SQL = f"""
WITH {_TEXTS_SQL}, {embed_sql('texts')}
SELECT id, CAST(b AS INTEGER) AS component, round(x, 9) AS value
FROM (SELECT id, unnest(v) AS x, unnest(range({DIMENSIONS})) AS b FROM em) WHERE x <> 0"""


def embed_norms(spark, sf_dir):
    """Dimensions and length of every text's vector: 1, or 0 without content words."""
    v = vector_to_array("features")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    vectors = embed(_articles(spark, sf_dir))
    return vectors.select("id", F.size(v).alias("dimensions"), F.round(length, 9).alias("length"))


EMBED_NORMS_SQL = f"""
WITH {_TEXTS_SQL}, {embed_sql('texts')}
SELECT id, {DIMENSIONS} AS dimensions, CAST(list_max(list_transform(v, lambda x: abs(x))) > 0 AS INTEGER)::DOUBLE AS length FROM em"""


def similar_keywords(spark, sf_dir):
    """Each document's content words as a topic, by the default vectors."""
    topics = _articles(spark, sf_dir).select(
        (F.col("id") - F.col("id") % DIGEST).alias("digest"), F.col("id").alias("pos"),
        content_tokens(F.col("content")).alias("keywords"),
    )
    return filter_similar_topics(topics).select("digest", "pos", F.array_join("keywords", " ").alias("keywords"))


SIMILAR_KEYWORDS_SQL = f"""
WITH RECURSIVE topics AS (
  SELECT doc_id AS id, array_to_string({sql_content_tokens('text')}, ', ') AS content FROM documents),
{embed_sql('topics')}, rows_ AS (SELECT id - id % {DIGEST} AS digest, id AS pos, v AS e FROM em),
{similar_sql('rows_', THRESHOLD)}
SELECT digest, pos, replace(content, ', ', ' ') AS keywords FROM stay JOIN topics ON id = pos"""


def fit_kmeans(spark, sf_dir):
    points = _points(spark, sf_dir).select("id", "features")
    return kmeans(points, 5).assign(points).select("id", "cluster_id")


def kmeans_nearest(spark, sf_dir):
    """Whether the centre of its cluster is the nearest to a row, which k-means promises."""
    points = _points(spark, sf_dir).select("id", "features")
    fitted = kmeans(points, 5)
    rows = [(number, (fitted.centres[place] / fitted.unit).tolist()) for place, number in fitted.numbers.items()]  # five
    near = nearest_centroid(points, spark.createDataFrame(rows, "cluster_id int, centroid array<double>"))
    return fitted.assign(points).join(near, "id").select("id", (F.col("cluster_id") == F.col("nearest")).alias("own_is_nearest"))


def kmeans_sql(source: str, ks, dimensions: int, name: str = "km") -> str:
    """CTEs ending in ``name(k, id, cluster_id)``: k-means of ``source(id, v DOUBLE[])``, round by round.

    ``name_q(id, v)`` has the points in whole numbers, ``name_l`` the places of the last centres.
    """
    def u(salt):
        return f"((('0x' || substr(md5('{SEED}:{salt}:' || id), 1, 13))::BIGINT + 1) / pow(2, 52))"

    k = max(ks)
    out = [f"""
{name}_u AS (SELECT pow(2, {BITS} - floor(log2(max(list_max(list_transform(v, lambda x: abs(x)))))) - 1) AS u FROM {source}),
{name}_q AS MATERIALIZED (SELECT id, list_transform(v, lambda x: floor(x * u + 0.5)) AS v FROM {source}, {name}_u),
{name}_e AS MATERIALIZED (SELECT * FROM (SELECT id, unnest(v)::BIGINT AS x, unnest(range(len(v))) AS i FROM {name}_q) WHERE x <> 0),
{name}_s0 AS MATERIALIZED (SELECT id, v FROM {name}_q ORDER BY {u('first')}, id LIMIT 1)"""]
    for r in range(SEED_ROUNDS):
        out.append(f"""
{name}_a{r} AS (SELECT q.id, min(list_distance(q.v, s.v)) ** 2 AS d FROM {name}_q q, {name}_s{r} s GROUP BY q.id),
{name}_s{r + 1} AS MATERIALIZED (SELECT id, v FROM {name}_s{r} UNION ALL (
  SELECT id, v FROM {name}_a{r} JOIN {name}_q USING (id) WHERE d > 0 ORDER BY -ln({u(f'round{r}')}) / d, id LIMIT {OVERSAMPLING * k}))""")
    out.append(f"""
{name}_w AS MATERIALIZED (SELECT id, count(*) AS n FROM (
  SELECT s.id, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, s.v), s.id) AS r
  FROM {name}_q q, {name}_s{SEED_ROUNDS} s) WHERE r = 1 GROUP BY id),
{name}_p0 AS MATERIALIZED (SELECT 0 AS j, id, v FROM {name}_w JOIN {name}_q USING (id) ORDER BY -ln({u('pick0')}) / n, id LIMIT 1)""")
    for j in range(1, k):
        out.append(f"""
{name}_p{j} AS MATERIALIZED (SELECT j, id, v FROM {name}_p{j - 1} UNION ALL (
  SELECT {j}, id, v FROM (SELECT w.id, any_value(q.v) AS v, any_value(n) * min(list_distance(q.v, p.v)) ** 2 AS pull
    FROM {name}_w w JOIN {name}_q q USING (id), {name}_p{j - 1} p GROUP BY w.id)
  WHERE pull > 0 ORDER BY -ln({u(f'pick{j}')}) / pull, id LIMIT 1))""")
    values = ", ".join(f"({i})" for i in ks)
    out.append(f"""
{name}_c0 AS MATERIALIZED (SELECT k, j, v FROM {name}_p{k - 1}, (VALUES {values}) AS t(k) WHERE j < k)""")
    for t in range(ROUNDS):
        last = t == ROUNDS - 1
        out.append(f"""
{name}_l{'' if last else t} AS MATERIALIZED (SELECT k, id, j FROM (
  SELECT k, q.id, j, row_number() OVER (PARTITION BY k, q.id ORDER BY list_distance(q.v, c.v), j) AS r FROM {name}_q q, {name}_c{t} c) WHERE r = 1)""")
        if not last:
            out.append(f"""
{name}_n{t} AS (SELECT k, j, count(*) AS n FROM {name}_l{t} GROUP BY k, j),
{name}_m{t} AS (SELECT k, j, i, sum(x) AS total FROM {name}_l{t} JOIN {name}_e USING (id) GROUP BY k, j, i),
{name}_c{t + 1} AS MATERIALIZED (
  SELECT k, j, list(coalesce(total, 0)::DOUBLE / n ORDER BY d.i) AS v
  FROM {name}_n{t} CROSS JOIN range({dimensions}) AS d(i) LEFT JOIN {name}_m{t} USING (k, j, i) GROUP BY k, j
  UNION ALL SELECT k, j, v FROM {name}_c{t} ANTI JOIN {name}_n{t} USING (k, j))""")
    out.append(f"""
{name}_f AS (SELECT k, j, row_number() OVER (PARTITION BY k ORDER BY min(id)) - 1 AS cluster_id FROM {name}_l GROUP BY k, j),
{name} AS (SELECT k, id, CAST(cluster_id AS INTEGER) AS cluster_id FROM {name}_l JOIN {name}_f USING (k, j))""")
    return ",".join(out)


def best_k_sql(name: str = "km") -> str:
    """CTE ``name_scores(k, silhouette, chosen)`` of the clusterings of ``kmeans_sql``, from all distances."""
    return f"""
{name}_d AS (SELECT a.id, b.id AS other, list_distance(a.v, b.v) ** 2 AS d FROM {name}_q a, {name}_q b),
{name}_sums AS (SELECT x.k, x.id, x.j AS own, y.j AS c, sum(d) AS total, count(*) AS n
  FROM {name}_d JOIN {name}_l x USING (id) JOIN {name}_l y ON y.k = x.k AND y.id = other GROUP BY ALL),
{name}_ab AS (SELECT k, id, max(n) FILTER (WHERE own = c) AS size, max(total) FILTER (WHERE own = c) AS within,
  min(total / n) FILTER (WHERE own <> c) AS b FROM {name}_sums GROUP BY k, id),
{name}_sil AS (SELECT k, CASE WHEN size = 1 THEN 0 ELSE (b - within / (size - 1)) / greatest(within / (size - 1), b) END AS s FROM {name}_ab),
{name}_may AS (SELECT k FROM {name}_l GROUP BY k HAVING k < count(*) AND count(DISTINCT j) BETWEEN 2 AND count(*) - 1),
{name}_scores AS MATERIALIZED (SELECT k, silhouette, row_number() OVER (ORDER BY silhouette DESC, k) = 1 AS chosen
  FROM (SELECT k, round(avg(s), 9) AS silhouette FROM {name}_sil JOIN {name}_may USING (k) GROUP BY k))"""


def clustered_sql(source: str) -> str:
    """CTEs ending in ``clustered(id, cluster_id, content)`` and ``labels(cluster_id, cluster_label)`` of ``source(id, content)``."""
    ks = range(MIN_CLUSTERS, MAX_CLUSTERS + 1)
    return f"""
{embed_sql(source)}, {kmeans_sql('em', ks, DIMENSIONS)}, {best_k_sql()},
clustered AS MATERIALIZED (
  SELECT id, cluster_id, content FROM {source} JOIN km USING (id)
  WHERE k = coalesce((SELECT min(k) FROM km_scores WHERE chosen), {MIN_CLUSTERS})),
{terms_sql('clustered')}, {global_units_sql('clustered')},
c_n AS (SELECT cluster_id, count(*) AS n FROM clustered GROUP BY cluster_id),
c_w AS (SELECT cluster_id, term, sum(w) AS total FROM unit GROUP BY cluster_id, term),
c_m AS (SELECT cluster_id, term, coalesce(total, 0) / n AS mean FROM c_n CROSS JOIN idfs LEFT JOIN c_w USING (cluster_id, term)),
c_r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(mean, 9) DESC, term DESC) AS r FROM c_m),
labels AS (SELECT cluster_id, string_agg(term, ', ' ORDER BY r) AS cluster_label FROM c_r WHERE r <= 3 GROUP BY cluster_id)"""


_VECTORS_SQL = "vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
_EMBEDDING = 64  # numbers of a test vector
KMEANS_SQL = f"WITH {_VECTORS_SQL}, {kmeans_sql('vectors', [5], _EMBEDDING)} SELECT id, cluster_id FROM km"
BEST_K_SQL = f"""WITH {_VECTORS_SQL}, {kmeans_sql('vectors', range(MIN_CLUSTERS, MAX_CLUSTERS + 1), _EMBEDDING)}, {best_k_sql()}
SELECT CAST(k AS INTEGER) AS k, silhouette, chosen FROM km_scores"""


def score_labelings(spark, sf_dir):
    """The silhouette of nine given labelings of all vectors, and which one is chosen."""
    ks = range(MIN_CLUSTERS, MAX_CLUSTERS + 1)
    points = _points(spark, sf_dir)
    given = points.select("features", *[((F.col("id") + F.col("cluster_id")) % k).cast("int").alias(f"c{k}") for k in ks])
    runs = mean_silhouettes_squared(materialize(given, "labelings"), "features", [f"c{k}" for k in ks])
    scores = {ks[run]: round(float(score), 9) for run, score in runs}
    chosen = best_k(scores, MIN_CLUSTERS)
    return spark.createDataFrame([(k, s, k == chosen) for k, s in scores.items()], "k int, silhouette double, chosen boolean")


SCORES_SQL = f"""
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
d AS (SELECT a.id, a.label, b.id AS other, b.label AS other_label, list_distance(a.v, b.v) ** 2 AS d FROM v a, v b),
sums AS (SELECT id, CAST(k AS INTEGER) AS k, (id + label) % k AS own, (other + other_label) % k AS c, sum(d) AS total, count(*) AS n
         FROM d, range({MIN_CLUSTERS}, {MAX_CLUSTERS + 1}) AS t(k) GROUP BY ALL),
ab AS (SELECT id, k, max(n) FILTER (own = c) AS size, max(total) FILTER (own = c) AS within,
              min(total / n) FILTER (own <> c) AS b FROM sums GROUP BY id, k),
s AS (SELECT k, CASE WHEN size = 1 THEN 0 ELSE (b - within / (size - 1)) / greatest(within / (size - 1), b) END AS s FROM ab),
scores AS (SELECT k, round(avg(s), 9) AS silhouette FROM s GROUP BY k)
SELECT k, silhouette, row_number() OVER (ORDER BY silhouette DESC, k) = 1 AS chosen FROM scores"""


def fit_best_k(spark, sf_dir):
    """The silhouette of each k, and which one was chosen."""
    fitted = choose_k(_points(spark, sf_dir).select("id", "features"))
    rows = [(k, round(float(s), 9), k == fitted.k) for k, s in sorted(fitted.scores.items())]
    return spark.createDataFrame(rows, "k int, silhouette double, chosen boolean")


def _language_clusters(spark, sf_dir):
    """The languages as clusters, numbered in their order."""
    docs = _articles(spark, sf_dir)
    numbers = Window.orderBy("lang")  # over the distinct languages only
    languages = docs.where("lang IS NOT NULL").select("lang").distinct().select(
        "lang", (F.row_number().over(numbers) - 1).alias("cluster_id")
    )
    return docs.join(broadcast_if_small(languages), "lang").select("id", "cluster_id", "content")


def lda_topics(spark, sf_dir):
    return cluster_topics(_language_clusters(spark, sf_dir))


def lda_primary(spark, sf_dir):
    docs = _language_clusters(spark, sf_dir)
    space = TfidfSpace(docs)
    vectors = materialize(space.transform(docs).select("id", "cluster_id", "tfidf"), "lda-vectors")
    return primary_topics(vectors, space).withColumn("related_topics", F.array_join("related_topics", " | "))


def terms_sql(source: str) -> str:
    """CTE ``terms(id, cluster_id, term)`` of ``source(id, cluster_id, content)``."""
    return f"""
words AS (SELECT id, cluster_id, {sql_content_tokens('content')} AS w FROM {source}),
terms AS MATERIALIZED (
  SELECT id, cluster_id, unnest(w) AS term FROM words
  UNION ALL
  SELECT id, cluster_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM words)"""


def global_units_sql(source: str) -> str:
    """CTEs ``idfs(term, idf)`` and ``unit(id, cluster_id, term, w)``: weights of one vocabulary for all clusters."""
    return f"""
vocab AS (SELECT term, count(*) AS ctf, count(DISTINCT id) AS df FROM terms GROUP BY term ORDER BY ctf DESC, term LIMIT {VOCABULARY}),
idfs AS MATERIALIZED (SELECT term, ln((1 + (SELECT count(*) FROM {source})) / (1 + df)) + 1 AS idf FROM vocab),
tf AS (SELECT id, cluster_id, term, count(*) AS tf FROM terms GROUP BY id, cluster_id, term),
weighted AS (SELECT id, cluster_id, term, tf * idf AS w FROM tf JOIN idfs USING (term)),
unit AS MATERIALIZED (SELECT id, cluster_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM weighted)"""


def own_units_sql(source: str) -> str:
    """As ``global_units_sql`` with ``idfs(cluster_id, term, idf)``: a vocabulary for each cluster."""
    return f"""
counts AS (SELECT cluster_id, term, count(*) AS ctf, count(DISTINCT id) AS df FROM terms GROUP BY cluster_id, term),
vocab AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ctf DESC, term) AS r FROM counts) WHERE r <= {VOCABULARY}),
n AS (SELECT cluster_id, count(*) AS n FROM {source} GROUP BY cluster_id),
idfs AS MATERIALIZED (SELECT cluster_id, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM vocab JOIN n USING (cluster_id)),
tf AS (SELECT id, cluster_id, term, count(*) AS tf FROM terms GROUP BY id, cluster_id, term),
weighted AS (SELECT id, cluster_id, term, tf * idf AS w FROM tf JOIN idfs USING (cluster_id, term)),
unit AS MATERIALIZED (SELECT id, cluster_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM weighted)"""


def topics_sql(slots: str, topics: str) -> str:
    """CTEs ending in ``topics(cluster_id, k, weight, terms)`` of ``unit``, round by round.

    ``slots`` selects (cluster_id, term) of all terms of each cluster, ``topics`` (cluster_id, k) its number of topics.
    """
    start = f"(0.5 + ('0x' || substr(md5('{SEED}:' || i || ':' || term), 1, 13))::BIGINT / pow(2, 52))"
    out = [f"""
slots AS MATERIALIZED ({slots}),
many AS MATERIALIZED (SELECT cluster_id, k, 1.0::DOUBLE / k AS more, count(*) AS v FROM slots JOIN ({topics}) USING (cluster_id) GROUP BY ALL),
whole AS (SELECT cluster_id, term, sum(w) AS w FROM unit GROUP BY cluster_id, term),
t_n0 AS MATERIALIZED (SELECT cluster_id, term, i, coalesce(w, 0) * ({start} / k) AS n
  FROM slots JOIN many USING (cluster_id) LEFT JOIN whole USING (cluster_id, term), range({MAX_TOPICS}) AS r(i) WHERE i < k)"""]
    for t in range(TOPIC_ROUNDS):
        out.append(f"""
t_b{t} AS MATERIALIZED (SELECT cluster_id, term, i, (n + more) / (sum(n) OVER (PARTITION BY cluster_id, i) + v * more) AS b
  FROM t_n{t} JOIN many USING (cluster_id)),
t_f{t} AS (SELECT id, cluster_id, i, w * b / sum(b) OVER (PARTITION BY id, term) AS g FROM unit JOIN t_b{t} USING (cluster_id, term)),
t_p{t} AS (SELECT id, i, sum(g) + any_value(more) AS p FROM t_f{t} JOIN many USING (cluster_id) GROUP BY id, i),
t_g{t} AS (SELECT cluster_id, term, i, w * (b * p) / sum(b * p) OVER (PARTITION BY id, term) AS g
  FROM unit JOIN t_b{t} USING (cluster_id, term) JOIN t_p{t} USING (id, i)),
t_s{t} AS (SELECT cluster_id, term, i, sum(g) AS n FROM t_g{t} GROUP BY cluster_id, term, i),
t_n{t + 1} AS MATERIALIZED (SELECT cluster_id, term, i, coalesce(s.n, 0) AS n FROM t_n{t} LEFT JOIN t_s{t} s USING (cluster_id, term, i))""")
    out.append(f"""
t_r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, i ORDER BY round(n, 9) DESC, term DESC) AS r FROM t_n{TOPIC_ROUNDS}),
topics AS (SELECT cluster_id, i, round(sum(n), 9) AS weight, string_agg(term, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS terms
  FROM t_r GROUP BY cluster_id, i)""")
    return ",".join(out)


_LANGUAGES_SQL = """
clustered AS (
  SELECT doc_id AS id, CAST(cluster_id AS INTEGER) AS cluster_id, text AS content
  FROM documents JOIN (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS cluster_id
                       FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) USING (lang))"""
RANKED_TOPICS_SQL = """
ranked AS (SELECT cluster_id, list(terms ORDER BY weight DESC, terms DESC) AS l FROM topics GROUP BY cluster_id)"""
GLOBAL_SLOTS_SQL = "SELECT cluster_id, term FROM (SELECT DISTINCT cluster_id FROM {0}), idfs"
TOPIC_NUMBER_SQL = f"SELECT cluster_id, least({MAX_TOPICS}, count(*)) AS k FROM {{0}} GROUP BY cluster_id"

LDA_PRIMARY_SQL = f"""
WITH {_LANGUAGES_SQL}, {terms_sql('clustered')}, {global_units_sql('clustered')},
{topics_sql(GLOBAL_SLOTS_SQL.format('clustered'), TOPIC_NUMBER_SQL.format('clustered'))}, {RANKED_TOPICS_SQL}
SELECT cluster_id, l[1] AS primary_focus, array_to_string(l[2:], ' | ') AS related_topics FROM ranked"""

LDA_TOPICS_SQL = f"""
WITH {_LANGUAGES_SQL}, {terms_sql('clustered')}, {own_units_sql('clustered')},
{topics_sql('SELECT cluster_id, term FROM idfs', f'SELECT DISTINCT cluster_id, {TOPICS} AS k FROM clustered')}
SELECT cluster_id, string_agg(terms, ' | ' ORDER BY i) AS topics FROM topics GROUP BY cluster_id"""

QUERIES = {
    "silhouette": cluster_silhouette,
    "silhouette_squared": cluster_silhouette_squared,
    "nearest_centroid": cluster_nearest,
    "cosine_to_centroid": cosine_to_centroid,
    "distance_to_centroid": distance_to_centroid,
    "representatives": cluster_representatives,
    "similar_topics": similar_topics,
    "similar_topic_keywords": similar_keywords,
    "score_labelings": score_labelings,
    "embed": embed_texts,
    "embed_components": embed_components,
    "similar_in_one": similar_in_one,
    "embed_norms": embed_norms,
    "kmeans": fit_kmeans,
    "kmeans_nearest": kmeans_nearest,
    "choose_k": fit_best_k,
    "lda_topics": lda_topics,
    "lda_primary": lda_primary,
}

ORACLE = {
    "silhouette": _silhouette_sql("euclidean", "list_distance(a.v, b.v)"),
    "silhouette_squared": _silhouette_sql("squared_euclidean", "list_distance(a.v, b.v) ** 2"),
    "nearest_centroid": NEAREST_SQL,
    "cosine_to_centroid": f"WITH {_POINTS_SQL} SELECT id, round(list_cosine_similarity(v, c), 9) AS cosine FROM points JOIN centres USING (cluster_id)",
    "distance_to_centroid": f"WITH {_POINTS_SQL} SELECT id, round(list_distance(v, c), 9) AS distance FROM points JOIN centres USING (cluster_id)",
    "representatives": REPRESENTATIVES_SQL,
    "similar_topics": SIMILAR_SQL,
    "score_labelings": SCORES_SQL,
    "embed_components": EMBED_SQL,
    "similar_in_one": SIMILAR_ONE_SQL,
    "similar_topic_keywords": SIMILAR_KEYWORDS_SQL,
    "embed_norms": EMBED_NORMS_SQL,
    "kmeans": KMEANS_SQL,
    "kmeans_nearest": "SELECT vec_id AS id, true AS own_is_nearest FROM embeddings",
    "choose_k": BEST_K_SQL,
    "lda_primary": LDA_PRIMARY_SQL,
    "lda_topics": LDA_TOPICS_SQL,
}
