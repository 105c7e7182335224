"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (
    decontaminate, jaccard, language, licenses, lines, maintext, neighbours, packing, phrases, pii, toxicity, urlrules,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    models = language.train(docs.where(_fold(3) != 1))
    return language.identify(docs, models).withColumn("held_out", F.coalesce(_fold(3) == 1, F.lit(False)))


# The rules of the query.
URL_RULES = (
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(_table(spark, sf_dir, "pages"), rules)


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
OP3_SQL = f"""
WITH r(h, p, v) AS (VALUES {_RULES_SQL}),
a AS (SELECT page_id, {_REST} AS rest, row_number() OVER () AS i FROM pages),
u AS (SELECT i, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urlrules.UPPER}', '{urlrules.LOWER}') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
m AS (SELECT i, h || p AS rule, v, row_number() OVER (PARTITION BY i ORDER BY length(h || p) DESC, length(h) DESC, h || p DESC) AS k
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (i)"""


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(_table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(_fold(4) != 2))
    held_out = F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=20, every=20)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), least=10, inside_percent=50, first=2000)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup(_table(spark, sf_dir, "documents"), least=20, documents=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=16)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_language_id, op3_url_filters, op4_html_extraction, op5_jaccard_join,
        op6_decontamination, op7_toxicity, op8_pii, op9_nearest_neighbours, op10_license_scan, op11_phrase_collocations,
        op12_line_dedup, op13_embedding_whitening,
    )
}
ORACLE = {
    "op3_url_filters": OP3_SQL, "op10_license_scan": licenses.oracle(), "op11_phrase_collocations": phrases.oracle(),
    "op12_line_dedup": lines.oracle(),
}
