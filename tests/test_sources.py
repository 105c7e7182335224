"""Feeds, files, pages, harvest, sinks."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.lookup import lookup
from newsloom.operators.topk import top_k_per_group
from newsloom.plans.digest import fetch_content, with_row_id
from newsloom.plans.harvest import harvest
from newsloom.plans.view import cluster_markdown, cluster_view, render_blocks
from newsloom.schema import DIGEST
from newsloom.sinks import files as sinks
from newsloom.sources import feeds
from newsloom.sources.files import numbered, read_text_files, url_list
from newsloom.sources.pages import extract, fetch_text

FEED_SCHEMA = "pos long, title string, url string, source string, author string, publishedAt string"


def test_api_response(spark, tmp_path):
    articles = [
        {"title": "T", "url": "u", "source": {"name": "S"}, "author": "A", "publishedAt": "D"},
        {}, {"title": "T", "author": None, "source": None},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"status": "ok", "articles": articles}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"status": "ok", "articles": []}))
    rows = feeds.read_api_responses(spark, str(tmp_path)).orderBy("pos").drop("response").collect()
    assert [tuple(r) for r in rows] == [
        (0, "T", "u", "S", "A", "D"),
        (1, "No title", "#", "Unknown", "Unknown", "Unknown"),
        (2, "T", "#", "Unknown", "Unknown", "Unknown"),
    ]


def test_rows_of_several_files_get_ids_of_their_own(spark, tmp_path):
    for name in "ab":
        articles = [{"title": f"{name}{i}", "url": f"u{i}"} for i in range(3)]
        (tmp_path / f"{name}.json").write_text(json.dumps({"status": "ok", "articles": articles}))
        (tmp_path / f"{name}.txt").write_text(f"text {name}")
    entries = numbered(
        feeds.read_api_responses(spark, f"{tmp_path}/*.json").withColumn("path_ord", F.lit(0)), "response", "pos"
    )
    rows = with_row_id(entries).orderBy("id").collect()
    assert [r["title"] for r in rows] == ["a0", "a1", "a2", "b0", "b1", "b2"]
    assert len({r["id"] for r in rows}) == 6
    texts = numbered(read_text_files(spark, str(tmp_path)), "file").orderBy("pos").collect()
    assert [r["content"] for r in texts] == ["text a", "text b"] and texts[0]["pos"] < texts[1]["pos"]


def test_rss(spark, tmp_path):
    items = "".join(
        f"<item><title>t{i}</title><link>l{i}</link>"
        + ("" if i % 2 else '<source url="x">s</source><author>a</author><pubDate>d</pubDate>')
        + "</item>" for i in range(25)
    )
    (tmp_path / "feed.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    rows = feeds.read_rss(spark, str(tmp_path)).orderBy("pos").drop("feed").collect()
    assert len(rows) == 20
    assert [tuple(r) for r in rows[:2]] == [
        (0, "t0", "l0", "s", "a", "d"), (1, "t1", "l1", "Unknown", "Unknown", "Unknown"),
    ]


def _feed(spark, dates, topic="t", start=0):
    rows = [(start + i, f"t{i}", f"u{i}", "s", "a", d, topic) for i, d in enumerate(dates)]
    return spark.createDataFrame(rows, FEED_SCHEMA + ", topic string")


def test_latest_sorts_text_and_keeps_feed_order(spark):
    df = _feed(spark, ["2024-01-02", None, "2024-01-03", "2024-01-02", "Unknown"])
    assert [r["pos"] for r in feeds.latest(df, 4).collect()] == [1, 4, 2, 0]


def test_latest_by_time(spark):
    df = _feed(spark, ["Wed, 03 Jan 2024 10:00:00 GMT", "2024-01-04T00:00:00Z", "Unknown", "Fri, 05 Jan 2024 01:00:00 GMT"])
    assert [r["pos"] for r in feeds.latest(df, 4, by_time=True).collect()] == [3, 1, 0, 2]


def test_fallback_per_topic(spark):
    first = _feed(spark, ["2024"] * 3, "a")
    second = _feed(spark, ["2023"] * 12, "a").unionByName(_feed(spark, ["2023"] * 12, "b", 100))
    got = fetch_content(first, second).orderBy("topic", "rank").collect()
    assert [(r["topic"], r["pos"]) for r in got] == [("a", i) for i in range(3)] + [("b", 100 + i) for i in range(10)]


def test_search(spark):
    rows = [(i, "red Green blue" if i % 2 else "red", "en" if i < 90 else "fr") for i in range(100)]
    articles = spark.createDataFrame(rows, "pos long, content string, lang string")
    topics = spark.createDataFrame([("green RED",), (" ",), ("red black",)], "topic string")
    got = feeds.search(articles, topics).orderBy("rank").collect()
    assert [(r["topic"], r["pos"]) for r in got] == [("green RED", 2 * i + 1) for i in range(20)]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n\nthree")
    (tmp_path / "b.txt").write_text(" \n\t")
    (tmp_path / "c.md").write_text("no")
    assert [r["content"] for r in read_text_files(spark, str(tmp_path)).collect()] == ["one\ntwo\n\nthree"]


def test_url_list(spark):
    df = spark.createDataFrame([(" a \n\n\t\nb\r\na",)], "urls string")
    assert [tuple(r) for r in url_list(df, "urls").collect()] == [(0, "a"), (3, "b"), (4, "a")]


def _page(n):
    return f"<title>T{n}</title><p>{'x' * n}</p>"


PAGES = [
    (1, "http://a.org/1", _page(300)), (2, "http://a.org/1", _page(400)), (3, "http://a.org/2", _page(299)),
    (4, "http://a.org/3", _page(500)), (5, "http://a.org/premium", _page(500)), (6, "http://a.org/4", _page(600)),
]


def test_harvest(spark):
    urls = [
        (0, "bad"), (1, "http://a.org/3"), (2, "http://a.org/1"), (3, "http://a.org/1"), (4, "http://a.org/2"),
        (5, "http://a.org/premium"), (6, "http://a.org/none"), (7, None), (8, ""), (9, "http://a.org/4"),
        (10, "http://a.org/3"),
    ]
    status = [(f"http://a.org/{i}", s) for i, s in ((1, 200), (2, 200), (3, 200), (4, 404))]
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    listed = spark.createDataFrame(urls, "pos long, url string")
    links = spark.createDataFrame(status + [("http://a.org/1", 200)], "url string, status int")
    got = harvest(listed, pages, links).orderBy("pos").collect()
    assert [(r["pos"], r["title"], len(r["text"])) for r in got] == [(1, "T500", 500), (2, "T300", 300)]
    assert harvest(listed, pages).count() == 3


def test_fetch_text_keeps_repeats(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    listed = spark.createDataFrame(
        [(0, "http://a.org/3"), (1, "http://a.org/3"), (2, "http://a.org/2"), (3, None)], "pos long, url string"
    )
    assert {r["pos"] for r in fetch_text(listed, pages).collect()} == {0, 1}
    left = fetch_text(listed, pages, how="left").orderBy("pos").collect()
    assert [r["text"] is not None for r in left] == [True, True, False, False]


def test_lookup_splits_hot_keys(spark):
    rows = spark.range(1000).select(
        F.col("id").alias("pos"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key")
    )
    table = rows.select("key").distinct().where("key <> 'k3'").withColumn("v", F.length("key"))
    for how, n in (("inner", 999), ("left", 1000)):
        got = lookup(rows, table, "key", "pos", how, hot_rows=50)
        assert got.count() == n == got.select("pos").distinct().count()
        assert got.where("key = 'hot' AND v = 3").count() == 666


def test_top_k_in_two_levels(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    got = top_k_per_group(df, ["g"], [F.desc("x")], 1500, spread=["x"], splits=4)
    assert got.count() == 3000 and got.agg(F.min("x")).first()[0] == 2000


def test_csv_and_json(spark, tmp_path):
    rows = [('say "hi", ok', "u", "line\nbreak", None, "d", "c,", "s", "POSITIVE", 0.5)]
    df = sinks.create_table(spark, rows, DIGEST)
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert sinks.read_csv(spark, str(tmp_path / "csv"), DIGEST).collect() == df.collect()
    sinks.write_json(df, str(tmp_path / "json"))
    lines = "".join(p.read_text() for p in (tmp_path / "json").glob("part-*"))
    assert json.loads(lines)["author"] is None
    assert sinks.save_digest(df, str(tmp_path), "climate change").endswith("climate_change_clustered_articles")
    assert sinks.save_digest(df.limit(0), str(tmp_path), "x") is None


def _result(spark):
    articles = spark.createDataFrame(
        [(i, f"t{i}", "u", "src", "sum", s, label) for i, (s, label) in enumerate([
            ("POSITIVE", "b"), ("NEGATIVE", "b"), ("POSITIVE", "a"), ("No input Provided.", "c"),
            ("POSITIVE", None), ("NEGATIVE", "d"), ("POSITIVE", "e"), ("POSITIVE", "f"), ("POSITIVE", "g"),
        ])], "id long, title string, url string, source string, summary string, sentiment string, cluster_label string",
    )
    topics = spark.createDataFrame(
        [(0, "b", "old", ["x"]), (3, "b", "p", ["q", "r"]), (1, "a", "n", [])],
        "cluster_id int, cluster_label string, primary_focus string, related_topics array<string>",
    )
    return articles, topics


def test_view(spark):
    articles, topics = _result(spark)
    every = cluster_view(articles, topics, []).orderBy("cluster_label").collect()
    assert [tuple(r) for r in every] == [
        ("a", "n", [], 1), ("b", "p", ["q", "r"], 2), ("c", None, None, 1), ("d", None, None, 1), ("e", None, None, 1),
    ]
    positive = cluster_view(articles, topics, ["Positive"]).orderBy("cluster_label").collect()
    assert [(r["cluster_label"], r["article_count"]) for r in positive] == [
        ("a", 1), ("b", 1), ("e", 1), ("f", 1), ("g", 1),
    ]


def test_markdown_blocks(spark):
    articles, topics = _result(spark)
    blocks = render_blocks(cluster_markdown(articles, topics, ["Negative"]))
    assert blocks[0] == (
        "### 🧩 Cluster b\n**Primary Topic:** p\n\n**Related Topics:** q, r\n\n**Articles:** 1\n\n"
        "#### 📰 t1\n- **Source:** src\n- **Sentiment:** Negative\n"
        "<details><summary><strong>Summary</strong></summary>\nsum\n</details>\n- [Read Full Article](u)\n\n"
    )
    assert blocks[1].startswith("### 🧩 Cluster d\n**Articles:** 1") and blocks[2:] == ["", "", ""]
    nothing = render_blocks(cluster_markdown(articles, topics, ["Neutral"]))
    assert nothing == ["### ⚠️ No matching articles.", "", "", "", ""]


def test_lookup_null_keys(spark):
    rows = spark.createDataFrame([(0, "a"), (1, None), (2, None), (3, "b")], "pos long, key string")
    table = spark.createDataFrame([("a", 1), (None, 9)], "key string, v int")
    got = {r["pos"]: r["v"] for r in lookup(rows, table, "key", "pos", "left", hot_rows=1).collect()}
    assert got == {0: 1, 1: None, 2: None, 3: None}
    assert [r["pos"] for r in lookup(rows, table, "key", "pos").collect()] == [0]


def test_main_text_without_an_article_element(spark):
    long = "This block of running text has more than forty characters"
    pages = {
        "siblings": f"<body><article><p>{long} one</p></article><div>x</div><article><p>{long} two</article></body>",
        "plain": f"<nav><ul><li>{long}</li></ul></nav><div>{long} &amp; <b>bold</b><br>short</div><footer>{long}</footer><div>{long} end</div>",
        "nested": f"<aside><nav>{long}</nav>{long}</aside><p>{long} out</p></nav><p>{long} last</p>",
        "links": f"<div><a href='x'>{long}</a></div><div>{long} with <a>one link</a></div><li><a>a</a> {'w ' * 30}</li>",
        "hostile": "<nav>" * 3000 + long + "</nav>" * 3000 + f"<p>{long} after</p>",
        "none": "<div>short</div>", "empty": "",
    }
    df = spark.createDataFrame(list(pages.items()), "url string, html string")
    got = {r["url"]: r["text"] for r in extract(df, "main", min_length=0).collect()}
    assert got == {
        "siblings": f"{long} one {long} two", "plain": f"{long} & bold {long} end", "nested": f"{long} out {long} last",
        "links": f"{long} with one link a {'w ' * 30}".strip(), "hostile": f"{long} after", "none": "", "empty": "",
    }


def test_records_table(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title": "x", "n": 1}\n{"url": "u\\n"}\nno object\n')
    rows = {tuple(r) for r in sinks.records_table(spark, str(tmp_path)).select("title", "url", "n").collect()}
    assert rows == {("x", None, 1), (None, "u\n", None)}
    named = sinks.records_table(spark, str(tmp_path), T.StructType([T.StructField("url", T.StringType())]))
    assert sorted(named.collect(), key=str) == sorted([("u\n",), (None,)], key=str)
