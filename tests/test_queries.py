"""Every registered query against its SQL, and what must hold for those without."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from oracle import connect, difference, duckdb_result, spark_result

SF = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if not n.startswith("op")))
def test_same_as_sql(spark, con, name):
    got = spark_result(QUERIES[name](spark, SF))
    assert difference(got, duckdb_result(con, ORACLE[name])) is None
    assert got[1]


def test_embed(spark):
    rows = QUERIES["embed"](spark, SF).collect()
    lengths = {round(sum(x * x for x in r["embedding"]), 5) for r in rows}
    assert {len(r["embedding"]) for r in rows} == {512} and lengths <= {0.0, 1.0}


def test_choose_k(spark):
    rows = QUERIES["choose_k"](spark, SF).collect()
    assert [r["k"] for r in rows] == list(range(2, 11))
    best = max(rows, key=lambda r: (r["silhouette"], -r["k"]))
    assert [r for r in rows if r["chosen"]] == [best]


def test_kmeans_numbering(spark):
    rows = QUERIES["kmeans"](spark, SF).collect()
    first = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        first.setdefault(r["cluster_id"], len(first))
    assert all(k == v for k, v in first.items()) and len(first) == 5


@pytest.mark.parametrize("name", ["lda_topics", "lda_primary"])
def test_topics(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert sorted(r["cluster_id"] for r in rows) == [0, 1, 2, 3]
    for r in rows:
        topics = r["topics"].split(" | ") if name == "lda_topics" else [r["primary_focus"], *r["related_topics"].split(" | ")]
        assert len(topics) == (2 if name == "lda_topics" else 3)
        assert all(len(t.split(", ")) == 3 for t in topics)


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    labels = {}
    for r in rows:
        labels.setdefault(r["cluster_id"], set()).add(r["cluster_label"])
    assert rows and all(len(v) == 1 for v in labels.values()) and 2 <= len(labels) <= 10


def test_latest_headlines(spark):
    rows = QUERIES["latest_headlines"](spark, SF).collect()
    assert 0 < len(rows) <= 10
