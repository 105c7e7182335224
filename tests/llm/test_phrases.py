"""Phrases: filters against counters, the query against SQL and brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import phrases, queries
from oracle import connect, difference, duckdb_result, spark_result

SF = "/root/testdata/sf0.001"
U = np.uint64


def random_counts(rng, n, high=1000):
    ids = [rng.integers(0, 1 << 42, n, dtype=U) for _ in range(3)]
    return phrases.Counts.merged([phrases.Counts(*phrases.permute(*ids), rng.integers(1, high, n))])


def test_permutation_is_inverted():
    rng = np.random.default_rng(0)
    ids = [rng.integers(0, 1 << 42, 10_000, dtype=U) for _ in range(3)]
    ids[0][:2], ids[1][:2], ids[2][:2] = (0, (1 << 42) - 1), (0, (1 << 42) - 1), (0, (1 << 42) - 1)
    left, right = phrases.permute(*ids)
    assert max(int(left.max()), int(right.max())) < 1 << 63
    assert all((a == b).all() for a, b in zip(phrases.restore(left, right), ids))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 5_000])
@pytest.mark.parametrize("lead", [0, 1, 9])
def test_filters_are_lossless(n, lead):
    rng = np.random.default_rng(n)
    counts = random_counts(rng, n)
    leads = counts.left >> U(63 - lead) if lead else np.zeros(n, U)
    out = []
    for value in np.unique(leads):
        some = phrases.Counts(*(c[leads == value] for c in counts))
        out.append(phrases.unpack_filter(phrases.pack_filter(some, lead), int(value)))
    if out:
        assert all((a == np.concatenate(b)).all() for a, b in zip(counts, zip(*out)))
    assert len(phrases.unpack_filter(phrases.pack_filter(phrases.Counts.none(), lead), 0).n) == 0


def test_filters_are_compact():
    counts = random_counts(np.random.default_rng(1), 100_000, high=5)
    assert len(phrases.pack_filter(counts, 5)) < 16 * 100_000  # three words and a counter, 128 bits each


def test_merging_adds_counters():
    rng = np.random.default_rng(2)
    a, b = random_counts(rng, 500), random_counts(rng, 500)
    both = phrases.Counts.merged([a, b, a])
    want = Counter()
    for part in (a, b, a):
        want.update(dict(zip(zip(part.left.tolist(), part.right.tolist()), part.n.tolist())))
    assert dict(zip(zip(both.left.tolist(), both.right.tolist()), both.n.tolist())) == want
    assert list(zip(both.left.tolist(), both.right.tolist())) == sorted(want)


def test_halves_that_agree_in_one_only():
    left, right = np.asarray([5, 5, 5, 2], U), np.asarray([9, 1, 9, 9], U)
    got = phrases.Counts.merged([phrases.Counts(left, right, np.ones(4, np.int64))])
    assert list(zip(*(c.tolist() for c in got))) == [(2, 9, 1), (5, 1, 1), (5, 9, 2)]


def brute(rows, least=10, percent=50, first=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    some = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = defaultdict(list)
    for (lang, *words), a in some.items():
        longer = [c for g, c in some.items() if len(g) == 4 and len(words) == 2 and g[0] == lang and tuple(words) in (g[1:3], g[2:4])]
        if any(100 * c >= percent * a for c in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = f[lang, *words[:k]], f[lang, *words[k:]]
            cuts.append((10**6 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        phrase = " ".join(words)
        out[lang].append((-score, -a, phrase.encode(), phrase, l, r))
    rows = []
    for lang, own in out.items():
        for i, (score, a, _, phrase, l, r) in enumerate(sorted(own)[:first]):
            rows.append((lang, i + 1, phrase, -a, l, r, n[lang], -score))
    return sorted(rows)


SCHEMA = "doc_id long, text string, lang string, n string, word string, id string, f string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, l, "n", "w", "i", "f", "r") for i, (t, l) in enumerate(rows)], SCHEMA).repartition(3)


def made_up(seed):
    rng = random.Random(seed)
    words = ["new", "york", "of", "the", "a", "City", "x\x1cy", "é", "漢字", "\x00", "b\xa0c"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\r\n"]) for _ in range(rng.randint(1, 60)))
        rows.append((text, rng.choice(["en", "fr", None, "und"])))
    return rows + rows[:20] + [(None, "en"), ("", None), (" \t.,", "en"), ("one", "xx"), ("new york " * 500, "one"), ("w" * 300_000, "en")]


@pytest.mark.parametrize("least, percent, first", [(10, 50, 2000), (2, 80, 7), (3, 0, 2000)])
def test_equals_brute_force(spark, least, percent, first):
    rows = made_up(least)
    got = phrases.collocations(table(spark, rows), least, percent, first).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, percent, first)


def test_small_filters_and_slices_change_nothing(spark, monkeypatch):
    """Flushed filters, many ranges and texts cut in slices give the same counts."""
    rows = made_up(4)
    docs = table(spark, rows)
    ids, frequent = {}, np.full(1 << (phrases.FILTER_BITS - 3), 255, np.uint8)
    sc = spark.sparkContext
    known, bits = sc.broadcast(ids), sc.broadcast(frequent)
    two = sorted(map(tuple, phrases.merge_filters(phrases._filters(docs, known, bits, None, 0), 1).collect()))
    three = sorted(map(tuple, phrases.merge_filters(phrases._filters(docs, known, bits, bits, 0), 1).collect()))
    for lead, entries in ((0, 10), (4, 50), (11, 333)):
        got = phrases.merge_filters(phrases._filters(docs, known, bits, None, lead, entries), 1, entries)
        assert sorted(map(tuple, got.collect())) == two
        got = phrases.merge_filters(phrases._filters(docs, known, bits, bits, lead, entries), 1, entries)
        assert sorted(map(tuple, got.collect())) == three
    texts = [(t or "").encode() for t, _ in rows]
    for size in (1, 7, 64):
        monkeypatch.setattr(phrases, "SLICE", size)
        assert [[w for part in phrases._tokens(t) for w in part] for t in texts] == [
            t.translate(phrases._BYTES).replace(b"\n", b" \xff ").split() for t in texts
        ]


def test_words_with_one_hash_get_ids_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(phrases, "ID_BITS", 3)
    monkeypatch.setattr(phrases, "word_id", lambda lang, word: (phrases.xxhash.xxh64_intdigest(lang + b"\0" + word, seed=42) & 7) + 1)
    words = spark.createDataFrame([("en", f"w{i}", 20) for i in range(30)], "lang string, word string, f long")
    numbered, shared = phrases._numbered(words)
    ids = {r["word"]: r["id"] for r in numbered.collect()}
    assert len(set(ids.values())) == 30 and len(shared) >= 22
    for word, i in ids.items():
        assert shared.get((b"en", word.encode()), phrases.word_id(b"en", word.encode())) == i


def test_hash_of_the_tasks_is_that_of_spark(spark):
    words = [("en", "the"), ("fr", "été"), ("und", "\x00"), ("x", "w" * 100)]
    rows = spark.createDataFrame(words, "lang string, word string").select("lang", "word", phrases._id_column().alias("id")).collect()
    assert [r["id"] for r in rows] == [phrases.word_id(r["lang"].encode(), r["word"].encode()) for r in rows]


def test_scores_pass_64_bits(spark):
    a, l, r = 3_000_000_000_001, 4_000_000_000_003, 5_000_000_000_007
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrases._score(F.col("l"), F.col("r")).alias("s")).first()
    assert row["s"] == 10**6 * a * a // (l * r)


def test_nothing(spark):
    assert phrases.collocations(table(spark, [])).collect() == []
    assert phrases.collocations(table(spark, [(None, None), ("", "en")])).collect() == []


def test_query_equals_sql_with_rows(spark):
    got = spark_result(queries.op11_phrase_collocations(spark, SF))
    assert got[1] and difference(got, duckdb_result(connect(SF), queries.ORACLE["op11_phrase_collocations"])) is None
