"""Line dedup: SQL, brute force on odd rows, and the levels of the runs."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.llm import lines, queries
from oracle import connect, difference, duckdb_result, spark_result

SCHEMA = "doc_id long, text string, key string, gone string, last long, batch int, docs long"
FOOTER = "  All Rights Reserved by the Example Company \t"


def docs(spark, rows):
    """Rows with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "k", "g", 7, 1, 2) for i, t in rows], SCHEMA).repartition(3)


def brute(rows, least=20, documents=3):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip("\t\n\x0b\x0c\r "))

    holds = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least and i is not None:
                holds[key(line)].add(i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if not (len(holds.get(key(x), ())) >= documents and max(holds[key(x)]) != i)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def got(spark, rows, **how):
    out = lines.dedup(docs(spark, rows), **how).select("doc_id", "n_lines", "n_dropped", "text").collect()
    return sorted(map(tuple, out), key=repr)


ROWS = [
    (1, f"{FOOTER}\nfirst\n{FOOTER.lower()}"), (2, FOOTER), (3, f"x\n{FOOTER.upper()}\ny\n"), (4, None), (5, ""),
    (3, f"x\n{FOOTER.upper()}\ny\n"),  # a repeated row
    (2, "another text of a repeated id\nwith a line in two documents only"), (6, "with a line in two documents only"),
    (None, f"no id\n{FOOTER}"), (None, f"no id\n{FOOTER}"), (7, "\n\n \t\n"), (8, "é" * 20), (9, "é" * 20 + " "), (10, "\té" + "é" * 19),
    (11, "é" * 19), (12, "é" * 19), (13, "é" * 19), (14, "\x00 zero and more than twenty"), (15, "w" * 300_000), (16, "w" * 300_000), (17, "W" * 300_000),
    (18, "\n".join(f"a line of a long text, number {i % 400}" for i in range(30_000))),
    (19, "\n".join(f"a line of a long text, number {i}" for i in range(200))), (20, "a line of a long text, number 7\r\nrest"),
]


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_equals_brute_force_with_any_number_of_batches(spark, batches):
    assert got(spark, ROWS, batches=batches) == sorted(brute(ROWS), key=repr)


def test_sql_agrees_on_odd_rows(spark, tmp_path):
    docs(spark, ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    out = spark_result(queries.op12_line_dedup(spark, str(tmp_path)))
    want = sorted((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute([r for r in ROWS if r[0] is not None]))
    rows = queries.op12_line_dedup(spark, str(tmp_path)).where("doc_id IS NOT NULL").collect()
    assert sorted(map(tuple, rows)) == want
    con = __import__("duckdb").connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(out, duckdb_result(con, queries.ORACLE["op12_line_dedup"])) is None


def test_nothing(spark):
    assert got(spark, []) == []


def test_runs_are_levelled_and_settled_lines_are_not_added_again(spark):
    index = lines.LineRuns(spark, documents=3, fanout=3, buckets=2)

    def batch(ids, name):
        return spark.createDataFrame([(i, bytearray(k.encode())) for i in ids for k in ("common", name)], "doc_id long, key binary")

    index.add(batch(range(90, 96), "a"))
    index.add(batch(range(10, 14), "b"))  # earlier documents: "common" is settled
    assert [len(x) for x in index.levels] == [2]
    second = {bytes(r["key"]): (r["docs"], r["last"]) for r in index.levels[0][1].table.collect()}
    assert second == {b"b": (4, 13)}
    index.add(batch([200], "c"))  # a later document moves the last holder
    assert [len(x) for x in index.levels] == [0, 1]
    found = {bytes(r["key"]): r["last"] for r in index.repeated().collect()}
    assert found == {b"common": 200, b"a": 95, b"b": 13}
    run = index.levels[1][0].table
    plan = run.join(run.select("key", F.col("last").alias("other")), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # bucketed: runs merge without being dealt again
