"""The dealt operators against brute force, planted cases and odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import (
    decontaminate, jaccard, language, licenses, maintext, neighbours, packing, pii, queries, toxicity, urlrules,
)
from newsloom.llm.components import components
from newsloom.session import materialize
from oracle import connect, difference, duckdb_result, spark_result

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n string, tile string"


def docs(spark, texts):
    """Rows with a repeated row, nulls and extra columns whose names clash with inner ones."""
    rows = [(i, t, "en", "s", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


ODD = [None, "", " \n\t ", "one", "two words", "!!! ???", "x" * 300_000, "a b " * 30_000, "\x00 é 漢字 😀"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    got = spark_result(queries.QUERIES[name](spark, SF))
    assert difference(got, duckdb_result(connect(SF), queries.ORACLE[name])) is None


# ---------------------------------------------------------------- 1 packing

def test_packing_equals_the_public_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    real = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts = [*ODD[:6], ODD[7], ODD[8], " lead", "trail ", "a  b  c\n d", "<|endoftext|> x", *real]
    rows = packing.pack(docs(spark, texts)).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["length"] for r in own) == len(ids) and len(own) == -(-len(ids) // 1024)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for own in by_sequence.values():
        end = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 1024
    assert len(by_sequence) <= math.ceil(sum(r["length"] for r in rows) / 1024) + 1


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for capacity in (7, 20, 50):
        lengths = sorted((rng.randint(1, capacity) for _ in range(300)), reverse=True)
        free = []
        for n in lengths:  # one by one
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - n)
            else:
                free.append(capacity - n)
        plan = packing.plan_slots({n: lengths.count(n) for n in set(lengths)}, capacity)
        assert plan["first_sequence"].max(initial=-1) < len(free)
        used = set()
        for n in set(lengths):
            runs = sorted((r, s, e) for m, r, s, e in zip(plan["length"], plan["first_rank"], plan["first_sequence"], plan["per_sequence"]) if m == n)
            for at, (r, s, e) in enumerate(runs):
                stop = runs[at + 1][0] if at + 1 < len(runs) else lengths.count(n)
                used |= {s + i // e for i in range(stop - r)}
        assert len(used) == len(free)


def test_packing_nothing(spark):
    assert packing.pack(docs(spark, ["x"]).where("false")).collect() == []


# ---------------------------------------------------------------- 2 language

def test_kneser_ney_sums_to_one_and_equals_the_formula():
    keys, _ = language.grams([(0, "abab acab bac")], 3)
    gram, n = np.unique(keys, return_counts=True)
    models = language.LanguageModels.fit({"x": (gram, n)}, 3)
    symbols = [language.SPACE, *map(ord, "abc")]
    for head in ((ord("a"), ord("b")), (ord("z"), ord("a"))):
        base = (head[0] << 32) | (head[1] << 16)
        seen = np.exp(models._score(np.asarray([base | s for s in symbols], dtype=np.uint64), 3)).sum()
        unseen = np.exp(models._score(np.asarray([base | ord("q")], dtype=np.uint64), 3)).sum()
        assert abs(seen + unseen * 1 - 1) < 1e-4  # the alphabet and one symbol for all others


def test_language_model_has_all_grams(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 10_000))) for _ in range(65)]  # letters of their own each time
    models = language.train(docs(spark, texts).withColumn("lang", F.lit("zh")))
    seen = {tuple(t[i : i + 4]) for t in texts for i in range(len(t) - 3)}
    assert len(models.grams[-1].values) == len(seen) + len({t[:k] for t in texts for k in (1, 2, 3)}) > 600_000


def test_language_is_calibrated_on_all_rows(spark):
    rng = random.Random(4)
    letters = {"en": "abcdefgh", "de": "efghijkl", "fr": "a"}
    rows = [(lang, "".join(rng.choices(letters[lang], k=rng.randint(1, 9)))) for lang in rng.choices(["en", "en", "de"], k=2_600)]
    rows += [("fr", "aaa")] * 3 + [("en", None), ("en", "12"), (None, "abc")]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    models = language.train(table)
    scored = [(lang, text) for lang, text in rows if lang and text and text.isalpha()]
    entropy, _ = models.cross_entropy([text for _, text in scored])
    truth = np.asarray([models.languages.index(lang) for lang, _ in scored])
    own = entropy[np.arange(len(truth)), truth]
    losses = [np.log(np.exp((own[:, None] - entropy) / t).sum(axis=1)).mean() for t in language.TEMPERATURES]
    assert models.temperature == language.TEMPERATURES[np.argmin(losses)]
    assert models.bound.tolist() == [np.quantile(own[truth == at], 1 - language.REJECTED) for at in range(3)]


def test_language_ranks_are_exact(spark):
    rng = np.random.default_rng(5)
    values = {0: rng.normal(size=500), 1: np.repeat([2.5, -0.0, 3.5], 40), 2: np.asarray([1.0])}
    rows = [(lang, int(p)) for lang, own in values.items() for p in language._places(own)]
    places = spark.createDataFrame(rows, "lang int, place long").repartition(3)
    wanted = [(0, r) for r in (0, 1, 250, 498, 499)] + [(1, r) for r in (0, 39, 40, 79, 80, 119)] + [(2, 0)]
    found = language._places(np.asarray(language._of_rank(places, wanted, language._counts(places, 48)), np.int64)).view(np.float64)
    assert found.tolist() == [np.sort(values[lang])[r] for lang, r in wanted]


def test_language_held_out_and_odd_texts(spark):
    rows = queries.op2_language_id(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held) > 0
    train = docs(spark, ["the cat and the dog"] * 9 + ["der Hund und die Katze"] * 9)
    train = train.withColumn("lang", F.when(F.col("doc_id") < 9, "en").otherwise("de"))
    models = language.train(train)
    got = {r["doc_id"]: r for r in language.identify(docs(spark, [*ODD, "die Katze und"]), models).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 5)] == ["und"] * 4 and got[9]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = language.train(train.where("false"))
    assert {r["lang_pred"] for r in language.identify(docs(spark, ODD), empty).collect()} == {"und"}


# ---------------------------------------------------------------- 3 URLs

def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://A.NET", "http://a.net/x", "http://notnet/x", "https://b.example.net/en/1?q#f",
        "http://example.com/de/", "http://example.org/fr/x", "http://example.org/en/x", "ftp://x.net?y=/a", "http://a.net/x",
    ]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r["page_id"]: r for r in urlrules.judge(pages, rules).collect()}
    assert len(got) == len(urls)
    assert (got[0]["host"], got[0]["path"], got[2]["host"]) == ("", "", "") and got[3]["host"] == "a.net"
    assert [got[i]["rule"] for i in range(12)] == [
        None, None, None, None, "net/", None, "example.net/en/", "example.com/de/", "org/fr/", None, None, "net/",
    ]
    assert [got[i]["verdict"] for i in (4, 6, 7, 9)] == ["block", "allow", "block", "allow"]
    assert urlrules.judge(pages.where("false"), rules).count() == 0
    assert {r["verdict"] for r in urlrules.judge(pages, rules.where("false")).collect()} == {"allow"}


def test_bloom_filter_keeps_every_key(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    bloom = urlrules.bloom_filter(keys, "key", 32)
    other = spark.range(500).select(F.concat(F.lit("o"), F.col("id")).alias("key"))
    assert urlrules.possible(keys, "key", bloom, 32).count() == 500
    assert urlrules.possible(other, "key", bloom, 32).count() < 100


# ---------------------------------------------------------------- 4 HTML

def test_main_text(spark):
    page = (
        "<html><head><title>no</title></head><body><nav><a href=/>Menu</a></nav><div class='ad'>Buy now</div><article>"
        "<h1>A &amp; B</h1><p>One <b>two</b>\n three.<script>x('</p>')</script><p>Four&nbsp;five.</article>"
        "<div class=comments><p>Nice text, I must say</div><footer>&copy; me</footer></body>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>cut off in the middle of a sentence that is long <a hre"), (1, "u", page)]
    got = maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 5 and by[1]["text"] == "A & B One two three. Four five." and by[1]["n_chars"] == len(by[1]["text"])
    assert by[2]["text"] == by[3]["text"] == "" and by[4]["text"] == "cut off in the middle of a sentence that is long"


@pytest.mark.parametrize("open_, close", [
    ("<body class='has-sidebar'><article>", "</article></body>"),
    ("<body><div class='layout sidebar-right'><article>", "</article></div></body>"),
    ("<body><article class='post comments-open'>", "</article></body>"),
    ("<body><form id=aspnet><main>", "</main></form></body>"),
    ("<body><div class='sidebar'><article>", "</article></div></body>"),
    ("<body class=ad><div class='content hasSidebar'>", "</div></body>"),
    ("<body><nav class='main-menu' role=navigation>Home and more</nav><div role='main' class=social>", "</div></body>"),
])
def test_main_text_below_wrappers(open_, close):
    text = "<h1>A title</h1><p>The first paragraph of a text that goes on for a while, as texts do.<p>The second is here, too."
    comments = "<div class=comments><article><p>Nice text, I must say at some length, for I like it.</article></div>"
    want = "A title The first paragraph of a text that goes on for a while, as texts do. The second is here, too."
    assert maintext.main_text(f"<html>{open_}{text}{close}</html>", maintext.trained()) == want
    page = f"<html>{open_}{text}{close.replace('</body>', comments + '</body>')}</html>"
    if "layout" in open_:  # comments that are articles stay out
        assert maintext.main_text(page, maintext.trained()) == want


def test_tree_fits_its_table():
    tree = maintext.trained()
    for page in maintext.LABELLED:
        found = maintext.blocks(page)
        assert [b.text[0] == "+" for b in found] == list(tree.predict(maintext.features(found)))


# ---------------------------------------------------------------- 5 Jaccard

def brute_groups(texts, k, percent):
    sets = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k, percent, seed", [(4, 85, 1), (5, 80, 2), (1, 50, 3)])
def test_jaccard_equals_brute_force(spark, k, percent, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 6)  # so that tiles are cut into blocks
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    shared = [rng.choice(vocabulary) for _ in range(25)]
    texts = list(ODD[:6])
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 90, 200]))]
        texts.append(" ".join(base + shared))
        for _ in range(rng.choice([0, 2, 8])):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary).upper()
            texts.append(" ".join(copy + shared[: rng.choice([25, 25, 20])]))
    got = sorted(tuple(r) for r in jaccard.join(docs(spark, texts), k, percent).collect())
    assert got == brute_groups(texts, k, percent)


def test_jaccard_odd_tables(spark):
    table = docs(spark, ["a b c d e f"] * 2)
    assert jaccard.join(table.where("false")).collect() == []
    again = table.unionByName(table).unionByName(table.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(map(tuple, jaccard.join(again).collect()), key=str) == [(0, 2, 0), (0, 2, 0), (1, 2, 0), (1, 2, 0), (None, 2, 0)]


def test_jaccard_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (None, c + " end"), (None, "no partner at all here"), (None, ""), (5, None)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, 26, 1), (1, 26, 1), (2, 26, 1), (3, 26, 1), (4, 26, 4), (None, 27, 4), (None, 1, None), (None, 0, None), (5, 0, 5)], key=str
    )


def test_jaccard_hot_tiles_find_the_same_groups(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(80)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(copy))
    want = brute_groups(texts, 5, 80)
    monkeypatch.setattr(jaccard, "HOT_ROWS", 3)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    assert sorted(map(tuple, jaccard.join(docs(spark, texts)).collect())) == want


def test_jaccard_common_passages_bring_no_texts_together(spark, monkeypatch):
    rng = random.Random(9)
    passages = [" ".join(f"p{i}q{j}" for j in range(14)) for i in range(3)]
    texts = []
    for i in range(300):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 120))]
        texts.append(" ".join(own[:30] + rng.sample(passages, 2) + own[30:]))
    texts += [t + " end" for t in texts[:20]]
    met = []

    def written(df, label, *by):
        made = materialize(df, label, *by)
        if label == "jaccard-near":
            met.append(made.count())
        return made

    monkeypatch.setattr(jaccard, "materialize", written)
    got = sorted(map(tuple, jaccard.join(docs(spark, texts), 5, 80).collect()))
    assert got == brute_groups(texts, 5, 80)
    assert 20 <= met[0] <= 30


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_jaccard_first_hashes_of_similar_sets_meet(percent):
    rng = np.random.default_rng(10)
    bounds, levels = jaccard.Bounds(percent), rng.integers(0, 9, jaccard.BUCKETS).astype(np.uint8)
    for _ in range(400):
        both, more = rng.integers(1, 40), rng.integers(0, 12)
        hashes = rng.integers(0, 2**63, both + more, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        left = rng.random(more) < 0.5
        a, b = (np.sort(np.r_[hashes[:both], hashes[both:][own]]) for own in (left, ~left))
        similar = 100 * both >= percent * (both + more)
        if similar and more:
            x, y = bounds.tiles([a, b], levels)
            assert len(np.intersect1d(x, y))


def test_jaccard_sets_with_one_half_digest_get_names_of_their_own(spark):
    half = int.from_bytes(b"12345678", "little")
    rows = [(i, 0, 5, half, bytearray(d), None) for i, d in enumerate([b"12345678aaaaaaaa", b"12345678bbbbbbbb", b"12345678bbbbbbbb"])]
    schema = "doc_id long, text_hash long, n long, node long, digest binary, bits binary"
    named, shared = jaccard._named(spark.createDataFrame([*rows, (9, 0, 0, None, None, None)], schema))
    nodes = {r["doc_id"]: r["node"] for r in named.collect()}
    assert nodes[0] == half != nodes[1] == nodes[2] == shared[b"12345678bbbbbbbb"] and nodes[9] is None
    assert jaccard._node(b"12345678bbbbbbbb", shared) == nodes[1] and jaccard._node(b"12345678aaaaaaaa", shared) == half


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (201, 200), (200, 201)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 130)) and got[201] == 200
    assert len(got) == 40 + 29 + 1


# ---------------------------------------------------------------- 6 decontamination

def brute_leaks(texts, items, k=5, percent=80):
    from collections import Counter

    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    found = set()
    for d, text in enumerate(texts):
        w = cut(text)
        grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        for i, item in items:
            v = cut(item)
            own = Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
            n = sum(own.values())
            for s in range(max(1, len(grams) - n + 1)) if n and grams else ():
                window = Counter(grams[s : s + n])
                common = sum((window & own).values())
                if 100 * common >= percent * (sum(window.values()) + n - common):
                    found.add((d, i))
    return found


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 8, 20, 50])))) for i in range(12)] + [(90, None), (91, "")]
    texts = list(ODD)
    for i in range(40):
        copy = items[i % 12][1].split()
        for _ in range(i // 12):
            copy[rng.randrange(len(copy))] = word()
        body = [word() for _ in range(rng.randrange(60))]
        texts.append(" ".join([*body, *copy, *body[::-1]]).upper() + "!")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs(spark, texts), bench).collect()
    want = brute_leaks(texts, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 10
    left = decontaminate.drop_leaking(docs(spark, texts), bench)
    assert {r["doc_id"] for r in left.select("doc_id").collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.leaks(docs(spark, texts), bench.where("false")).collect() == []
    assert decontaminate.leaks(docs(spark, texts).where("false"), bench).collect() == []


def brute_best(text, item, k=5, percent=80):
    """(start, similarity) of the first most similar of all item-sized windows, if it reaches the threshold."""
    from collections import Counter

    grams = [[tuple(t[i : i + k]) for i in range(len(t) - k + 1)] for t in (text.split(), item.split())]
    n, best = len(grams[1]), (0.0, 0)
    for s in range(max(1, len(grams[0]) - n + 1)):
        window = Counter(grams[0][s : s + n])
        common = sum((window & Counter(grams[1])).values())
        best = max(best, (common / (sum(window.values()) + n - common), -s))
    return (-best[1], best[0]) if 100 * best[0] >= percent - 1e-9 else None


def test_leaks_of_items_with_moved_parts(spark):
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [(i, [word() for _ in range(rng.choice([40, 60, 100]))]) for i in range(8)]
    items.append((8, [f"r{i % 7}" for i in range(60)]))  # shingles that repeat
    texts = []
    for i in range(36):
        copy = list(items[i % 9][1])
        cut = rng.randrange(5, len(copy) - 5) if i >= 9 else len(copy) // 2
        copy = copy[cut:] + copy[:cut]
        if i % 4 == 3:
            copy[0] = copy[-1] = word()
        body = [word() for _ in range(rng.choice([0, 3, 80]))]
        texts.append(" ".join([*body, *copy, *body[::-1]]))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["similarity"]) for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    want = {(d, i): b for d, t in enumerate(texts) for i, w in items if (b := brute_best(t, " ".join(w)))}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-12 for p in want)


# ---------------------------------------------------------------- 7 toxicity

def test_kernel_tolerates_gaps():
    near = lambda word: float(toxicity.similarities([toxicity.plain(word)], toxicity.landmark_matrix(["moron"]))[0, 0])
    assert near("moron") > 0.999 and near("m.o.r.o.n") > 0.999
    assert near("morxon") > 0.6 > near("morning") and near("table") == 0


def test_kernel_equals_the_definition():
    def slow(a, b):
        def vector(w):
            out = {}
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, len(w)):
                        if k - i < toxicity.SPAN:
                            out[w[i], w[j], w[k]] = out.get((w[i], w[j], w[k]), 0) + toxicity.DECAY ** (k - i + 1)
            return out
        x, y = vector(a), vector(b)
        dot = lambda p, q: sum(v * q.get(t, 0) for t, v in p.items())
        return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))

    words = ["stupid", "stuupid", "stupidly", "banana", "ananas", "cup"]
    got = toxicity.similarities(words, toxicity.landmark_matrix(["stupid", "banana"]))
    for w, row in zip(words, got):
        for mark, value in zip(("stupid", "banana"), row):
            exact = slow(w, mark)
            assert abs(value - (exact if exact >= toxicity.FLOOR else 0)) < 1e-5


def test_few_tokens_are_known_at_once_and_descriptions_do_not_depend_on_it(monkeypatch):
    letter = lambda n: "".join(chr(97 + n // 26**i % 26) for i in range(4))
    texts = [" ".join(letter(150 * i + j) for j in range(150)) + " moron m o r o n" for i in range(1_000)]
    near = toxicity.Nearest(["moron", "banana"])
    whole = near.describe(texts)
    assert len(near._known) <= 131_000  # of 150,000; a block of 200 texts comes on top of the limit
    monkeypatch.setattr(toxicity, "PIECES", 7)
    assert (toxicity.Nearest(["moron", "banana"], 1_000).describe(texts[:20]) == whole[:20]).all()


def held_in_workers(spark, module, name):
    def run(batches):
        for batch in batches:
            yield batch.from_pydict({"n": [len(getattr(module, name))] * batch.num_rows})

    return {r["n"] for r in spark.range(0, 64, 1, 16).mapInArrow(run, "n long").collect()}


def test_tasks_leave_nothing_in_their_workers(spark):
    model = toxicity.ToxicityModel(["moron"], np.ones(2), 0.0, 1.0, 0.0)
    texts = [f"you m o r o n, word{i} and more words" for i in range(40)]
    assert len(toxicity.score(docs(spark, texts), model).collect()) == 40
    assert held_in_workers(spark, toxicity, "_nearest") == {0}
    assert len(jaccard.classes(docs(spark, texts).select("doc_id", "text")).collect()) == 40
    assert held_in_workers(spark, jaccard, "_words") == {0}


def test_a_task_gives_memory_back_after_its_own_is_gone():
    import weakref

    from newsloom.llm.workers import released

    class Held:
        pass

    held, seen = [], []

    def run(batches):
        own = Held()  # lives as long as the generator
        held.append(weakref.ref(own))
        yield from batches

    assert list(released(run, lambda: seen.append(held[0]() is None))([1, 2])) == [1, 2]
    assert seen == [True]
    assert list(released(run)([])) == []


def test_stages_of_the_pipeline_bound_the_bytes_of_a_batch(spark, monkeypatch):
    import pyarrow as pa

    import corpus_pipeline
    from newsloom.llm.workers import BATCH_BYTES

    def sizes(docs):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

        return docs.mapInArrow(run, "rows long, bytes long")

    monkeypatch.setattr(corpus_pipeline.pii, "mask", sizes)
    long = spark.range(0, 3_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2_000).alias("text"))
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.unset(BATCH_BYTES)
    try:
        got = corpus_pipeline.mask_personal_data(spark, long, SF).collect()
        assert sum(r["rows"] for r in got) == 3_000 and max(r["bytes"] for r in got) < 5 << 20
        spark.conf.set(BATCH_BYTES, "1m")  # a bound of the user's own stays
        got = corpus_pipeline.mask_personal_data(spark, long, SF).collect()
        assert sum(r["rows"] for r in got) == 3_000 and max(r["bytes"] for r in got) < 2 << 20
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def test_toxicity_held_out_and_odd_texts(spark):
    rng = random.Random(1)
    words = ["stone", "river", "cloud", "green", "walk", "table", "paper", "light"]
    bad = ["moron", "idiot", "scum"]
    texts = [" ".join([*rng.choices(words, k=30), *([rng.choice(bad)] * 2 if i % 4 == 0 else [])]) for i in range(160)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)] + [(5, None), (999, 1), (None, 0)], "doc_id long, toxic int")
    table = docs(spark, texts)
    model = toxicity.train(table, labels)
    plain = " ".join(words * 3)
    new = [*ODD, plain, f"{plain} idiot {plain} scum", f"{plain} m.o.r.o.n {plain} i d i o t"]
    got = {r["doc_id"]: r for r in toxicity.score(docs(spark, new), model).collect()}
    assert [got[i]["predicted"] for i in (9, 10, 11)] == [0, 1, 1] and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[0]["predicted"] == got[1]["predicted"] == 0
    nothing = toxicity.train(table, labels.where("false"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs(spark, ODD), nothing).collect())
    assert toxicity.score(table.where("false"), model).count() == 0


# ---------------------------------------------------------------- 8 PII

def naive_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choices("ab@.@-+ ()0123456789", k=rng.randrange(60)))
        assert pii.base_spans(text) == naive_spans(text)
    assert pii.luhn("4485275742308327") and not pii.luhn("4485275742308328")


def test_crf_marginals_and_held_out():
    model = pii.trained()
    right = 0
    made = pii.made_sentences(120, seed=31)
    for text, spans in made:
        x = pii.lattice(text, 0, len(text))
        p = model.marginals(x)
        assert p.min(initial=0) >= -1e-9 and p.max(initial=0) <= 1 + 1e-6
        right += model.best(x) == spans
    assert right >= 0.75 * len(made)


def test_held_out_through_the_regions():
    model = pii.trained()
    made = pii.made_sentences(240, seed=31)
    right = sum(pii.all_spans(text, model)[1] == spans for text, spans in made)
    assert right >= 0.75 * len(made)
    for text, spans in made:  # every e-mail address lies in a region
        assert all(any(a <= s and e <= b for a, b in pii.regions(text)) for s, kind, e in spans if kind == 0), text


@pytest.mark.parametrize("form", [
    "john.doe(at)example.com", "john.doe[at]example[dot]com", "john.doe at example Dot com", "john.doe at example dot com",
    "john.doe(AT)example.co.uk", "john.doe at example.com",
])
def test_spelt_addresses_are_found(form):
    text = f"please write to {form}, thanks"
    assert any(a <= 16 and kind == 0 and b >= 16 + len(form) for a, kind, b in pii.all_spans(text, pii.trained())[1])
    assert "[email]" in pii.masked(text, pii.trained()) and "example" not in pii.masked(text, pii.trained())


def test_pii_rows(spark):
    texts = [*ODD, "mail a.b@c.de or call +1 (017) 555-7713", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']
    got = {r["doc_id"]: r for r in pii.find(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert got[9]["n_email"] == got[9]["n_phone"] == 1 and got[9]["spans"].startswith("email:5:13")
    assert "secret:" in got[10]["spans"] and got[0]["spans"] == got[1]["spans"] == ""
    masked = {r["doc_id"]: r for r in pii.mask(docs(spark, texts)).collect()}
    assert masked[9]["text"] == "mail [email] or call [phone]" and masked[9]["n_chars"] == len(masked[9]["text"])
    assert masked[0]["text"] is None and masked[6]["text"] == ODD[6]


# ---------------------------------------------------------------- 9 neighbours

def test_neighbours_recall_and_odd_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {}
    for r in neighbours.nearest(rows, "vec_id", "embedding").collect():
        got.setdefault(r["query_id"], []).append(r)
    table = {r["vec_id"]: np.asarray(r["embedding"], dtype=np.float64) for r in rows.collect()}
    hits = 0
    for q in [i for i in table if i % 20 == 0]:
        best = sorted(((-float((v * table[q]).sum()), i) for i, v in table.items() if i != q))[:20]
        own = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(abs(r["score"] - float((table[r["vec_id"]] * table[q]).sum())) < 1e-12 for r in own)
        hits += len({i for _, i in best} & {r["vec_id"] for r in own})
    assert hits >= 0.9 * 20 * len(got)
    odd = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]),
           (6, [2.0, 0.0]), (20, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [2.0, 0.0])]
    small = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    rows = [tuple(r) for r in neighbours.nearest(small, "vec_id", "embedding").collect()]
    assert sorted(rows) == [(0, 1, 1, 2.0), (0, 2, 6, 2.0)]
    assert neighbours.nearest(small.where("false"), "vec_id", "embedding").collect() == []


def test_neighbours_recall_on_uneven_norms(spark):
    rng = np.random.default_rng(4)
    table = rng.standard_normal((9_000, 128))
    table *= (rng.lognormal(0, 0.1, len(table)) / np.linalg.norm(table, axis=1))[:, None]
    table[7] *= 8 / np.linalg.norm(table[7])  # one long outlier
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(rows, "vec_id", "embedding", every=60).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, len(table), 60):
        score = table @ table[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got) and len(got) == 150


# ---------------------------------------------------------------- 10 licenses

def test_license_rows(spark):
    texts = [
        *ODD, "Released under the MIT License.", "GNU General\nPublic License", "Released by all, under nothing",
        "x\nAll rights reserved.\ny", "mit license mit license",
    ]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert len(got) == len(texts) and got[0]["n_words"] == 0 and got[0]["labels"] == "" and got[0]["first_word"] is None
    assert (got[9]["labels"], got[9]["n_base"], got[9]["first_word"]) == ("mit", 1, 3)
    assert (got[10]["base_labels"], got[10]["n_base"]) == ("gpl", 1) and got[11]["labels"] == ""
    assert (got[12]["labels"], got[12]["base_labels"], got[12]["score"]) == ("all-rights-reserved", "", 1.0)
    assert (got[13]["n_base"], got[13]["first_word"], got[13]["last_word"]) == (2, 0, 2)
    assert licenses.scan(docs(spark, texts).where("false")).count() == 0


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    columns = table.columns
    before = table.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF)
        assert table.columns == columns, name
        table = spark.createDataFrame(table.toPandas(), table.schema)
        after = table.count()
        assert 0 < after <= before
        before = after
    rows = {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()}
    want = {tuple(r) for r in packing.pack(table).select("doc_id", "piece", "length", "ids_crc32").collect()}
    assert rows == want
    again = corpus_pipeline.one_of_each_group(spark, table, SF)
    assert again.count() == table.count()


def test_pipeline_judges_every_row(spark):
    import corpus_pipeline

    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").first()["text"]
    same, other = "one two three four five six seven", "some other text that is like nothing else here"
    rows = [(5, same), (3, same), (3, same), (None, same), (7, other), (None, item), (9, item), (8, ""), (8, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, table, SF).collect()]
    assert sorted(kept, key=str) == sorted([(3, same), (7, other), (9, item), (8, ""), (8, "")], key=str)
    clash = table.selectExpr("doc_id", "text", "'keep' AS row", "'a' AS _row", "1 AS one", "2L AS own", "'h' AS text_hash", "7.5 AS score", "3 AS component", "9 AS predicted")
    more = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, clash, SF).collect()]
    assert sorted(r[:2] for r in more if r[1] == same) == [(3, same)] and {r[2:] for r in more} == {tuple(clash.first())[2:]} and len(more) == 5
    assert {r[2:] for r in map(tuple, corpus_pipeline.drop_leaks(spark, clash, SF).collect())} == {tuple(clash.first())[2:]}
    clean = corpus_pipeline.drop_toxic(spark, clash, SF)
    assert clean.columns == clash.columns and {r[2:] for r in map(tuple, clean.collect())} == {tuple(clash.first())[2:]}
    left = [tuple(r) for r in corpus_pipeline.drop_leaks(spark, table, SF).collect()]
    assert sorted(left, key=str) == sorted([r for r in rows if r[1] != item], key=str)
