"""Hand-worked values for the scalar functions."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.functions import text as T
from newsloom.functions import urls as U
from newsloom.functions.sentiment import with_sentiment
from newsloom.functions.summary import best_sentences, with_summary
from newsloom.functions.topics import normalize_topic, reject_reason, topic_slug
from newsloom.functions.vectors import cosine, euclidean


def values(spark, inputs, function, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {type_}")
    rows = df.select("i", function(F.col("v")).alias("out")).collect()
    return [r["out"] for r in sorted(rows)]


def test_reject_reasons(spark):
    cases = {
        "": "empty", None: "empty", "x" * 101: "too_long", "x" * 100: None, "café": "non_ascii",
        "a\tb": "non_printable", "a\n": "non_printable", "5g": "starts_with_digit",
        " 5g": "starts_with_space", "?!": "empty_after_cleanup", "The of": "only_stop_words",
        "-5g": None, "A&B": None, "~`": None, "\x7f": "non_printable",
    }
    assert values(spark, list(cases), reject_reason) == list(cases.values())


def test_normalize_topic(spark):
    cases = {
        "Rise of the  A.I. in News!": "rise i news", "-5g": "5g", "tic~tac`toe": "tic~tac`toe",
        "war and peace and war": "war peace war", "back\\slash 'q' \"p\"": "back slash q p",
    }
    assert values(spark, list(cases), normalize_topic) == list(cases.values())


def test_topic_slug():
    assert [topic_slug(t) for t in ("climate change", "  ", "", None)] == [
        "climate_change", "batch_upload", "batch_upload", "batch_upload",
    ]


def test_url_checks(spark):
    cases = {
        "http://a.com": True, "HTTPS://A.COM/x?y=1": True, "ftp://a.org:21/f": True,
        "ftps://localhost": True, "http://1.2.3.4:80/": True, "http://[::1]/": True,
        "http://a.com#x": False, "http://a.com/#x": True, "http://a.com/a b": False,
        "a.com": False, "htp://a.com": False, "http://": False, "": False, None: False,
        "http://host": False, "http://a.com/a b": False, "http://a.com\n": True,
    }
    assert values(spark, list(cases), U.is_valid_url) == list(cases.values())
    urls = ["http://a.com/Paywall", "http://a.com/paywall", "http://premium.org", None, ""]
    assert values(spark, urls, U.is_paywalled) == [False, True, True, False, False]
    assert values(spark, urls, U.is_acceptable_url) == [True, False, False, False, False]
    blocked = ["https://notexample.com", "https://example.org", None]
    assert values(spark, blocked, U.is_blocked_site) == [True, False, False]


def test_content_checks(spark):
    rows = spark.createDataFrame(
        [(i, u, t) for i, (u, t) in enumerate([
            ("http://example.com/premium", "x"), ("http://example.com/premium", ""),
            ("http://example.com/premium", None), ("http://a.org", " "), (None, "x"),
        ])], "i int, u string, t string",
    ).orderBy("i")
    u, t = F.col("u"), F.col("t")
    got = rows.select(U.is_empty_content(t), U.is_paywalled_content(u, t), U.is_blocked_content(u, t))
    assert [tuple(r) for r in got.collect()] == [
        (False, True, True), (True, False, False), (True, False, False),
        (False, False, False), (False, False, False),
    ]


def test_capitalize(spark):
    assert values(spark, ["POSITIVE", "No input Provided.", "", "é"], T.capitalize) == [
        "Positive", "No input provided.", "", "É",
    ]


def test_clean_text(spark):
    long, fits = "w" * 100, "w" * 99
    cases = {
        f" a  b\x1c{long} {fits}\n": f"a b {fits}", "": "", "  \x85 ": "", "one": "one",
    }
    assert values(spark, list(cases), T.clean_text) == list(cases.values())
    python = [" ".join(w for w in s.split() if len(w) < 100) for s in cases]
    assert python == list(cases.values())


@pytest.mark.parametrize("n", [0, 1, 512, 513, 1024])
def test_chunks(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = values(spark, [" ".join(words)], lambda c: T.chunks_of(T.words(c)))[0]
    assert got == [" ".join(words[i:i + 512]) for i in range(0, n, 512)]


def test_strip_is_pythons(spark):
    cases = ["  a b \x1f　", "", " ", "a", "​a "]
    assert values(spark, cases, T.strip) == [s.strip() for s in cases]


def test_terms(spark):
    text = "The Cat_1 saw a cat_1, x über-cat"
    got = values(spark, [text], lambda c: T.with_bigrams(T.content_tokens(c)))[0]
    assert got == ["cat_1", "saw", "cat_1", "über", "cat",
                   "cat_1 saw", "saw cat_1", "cat_1 über", "über cat"]
    assert values(spark, ["", "one"], lambda c: T.with_bigrams(T.content_tokens(c))) == [[], ["one"]]


def test_html(spark):
    page = (
        '<html><head><!-- <title>no</title> --><TITLE lang="x"> A &amp;lt; B\n</TITLE>'
        '<script>var t="</p><p>no";</script></head><body><p class="a">One <b>bold</b>'
        "<p>Two &lt;3&nbsp;&quot;x&quot;</p> outside <pre>no</pre><p>Three</p>tail</body></html>"
    )
    body = lambda c: H.clean_body(H.paragraph_text(H.visible(c)))
    title = lambda c: H.clean_title(H.raw_title(H.visible(c)))
    assert values(spark, [page, "", "<p>"], body) == ['One bold Two <3 "x" Three', "", ""]
    assert values(spark, [page, "", "<title></title>", "<title> </title>"], title) == [
        "A &lt; B", "Untitled", "Untitled", "",
    ]


def test_entities(spark):
    cases = {
        "a &amp;lt; b": "a &lt; b", "&eacute;&#233;&#xE9;&#x1F4F0;": "ééé📰", "&copy; &middot; &apos;": "© · '",
        "AT&T & co": "AT&T & co", "&nope; &#0; &#xD800; &#99999999999; &;": "&nope; &#0; &#xD800; &#99999999999; &;",
        "": "", "&amp;": "&", "a&nbsp;b": "a\u00a0b", "&#12a;": "&#12a;",
    }
    assert values(spark, list(cases), H.decode_entities) == list(cases.values())


def test_summary(spark):
    text = (
        "Markets rose. The weather was calm! Markets fell and markets rose again?\n"
        "A dog barked. Markets markets markets. Of the"
    )
    df = spark.createDataFrame([(0, text), (1, "  "), (2, None), (3, "Of the. And so!"), (4, "...")],
                               "i int, content string")
    got = [r["summary"] for r in with_summary(df).orderBy("i").collect()]
    # "markets" 6 times, "rose" twice: 6 > (6+2)/2 > (6+1+6+2)/4 > 1
    assert got == [
        "Markets rose. Markets fell and markets rose again? Markets markets markets.",
        "No input provided.", "No input provided.", "Of the. And so!", "",
    ]


def test_sentiment(spark):
    df = spark.createDataFrame(
        [(0, "Good GOOD bad"), (1, "bad"), (2, "goodness"), (3, " "), (4, None)], "i int, summary string"
    )
    got = [(r["sentiment"], r["score"]) for r in with_sentiment(df, lexicon={"good": 1, "bad": -1}).orderBy("i").collect()]
    assert got == [
        ("POSITIVE", 0.731058579), ("NEGATIVE", 0.731058579), ("NEUTRAL", 0.5),
        ("No input provided.", 0.0), ("No input provided.", 0.0),
    ]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    row = df.select(cosine(a, b), cosine(a, z), euclidean(a, z)).first()
    assert list(row) == [0.96, 0.0, 5.0]


def test_nested_and_sibling_articles(spark):
    pages = {
        "<article><p>one</p><article><p>inner</p></article><p>two</p></article><article><p>three</p></article><p>no</p>": "one inner two three",
        "<p>no</p><article class='x'><p>one</p></article><p>no</p>": "one",
        "<article><p>never closed</p>": "", "<p>none</p>": "",
    }
    got = values(spark, list(pages), lambda c: H.clean_body(H.paragraph_text(H.article_element(c))))
    assert got == list(pages.values())


def test_best_sentences_of_a_batch_as_a_plain_loop():
    rng = random.Random(4)
    texts = [[[rng.choice("abcdefg") for _ in range(rng.randrange(5))] for _ in range(rng.randrange(8))] for _ in range(200)]
    texts += [None, [], [[]], [[], [], [], [], ["a"]], [["a", "b"], ["b", "a"], ["a"], ["b"], ["a", "a"]]]
    want = []
    for text in texts:
        n = Counter(w for sentence in text or [] for w in sentence)
        rank = [(-sum(n[w] for w in own) / max(1, len(own)), i) for i, own in enumerate(text or [])]
        want.append(sorted(i for _, i in sorted(rank)[:3]))
    got = best_sentences(pa.array(texts, pa.list_(pa.list_(pa.string()))), 3)
    assert got.to_pylist() == want
    assert best_sentences(pa.array([None] + texts, pa.list_(pa.list_(pa.string())))[1:], 3).to_pylist() == want  # a slice
