"""License scans: fixed phrases, and an exact containment join of text blocks with templates.

A text is split into words once, for the phrases and for the template words that
occur in it. Their counts over all documents give the global order, rarest
first. A block that holds enough of a template holds one of its prefix words, so
only documents that do are read again, block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.once import with_once
from newsloom.llm.urlrules import LOWER, UPPER
from newsloom.session import broadcast_if_small, materialize

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Wordings of license lines; a block (line) has the label if it holds enough of the words.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("apache", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mit", "released under the mit license"),
    ("all-rights-reserved", "all rights reserved"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
PERCENT = 90
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text whose A-Z are lower-cased already."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _places(phrase: str) -> Column:
    """Where the words of a phrase stand one after the other in column ``w``."""
    parts = phrase.split()
    first = parts[0]
    same = lambda i: F.expr("true") if not parts[1:] else _all(
        F.get(F.col("w"), i + j) == word for j, word in enumerate(parts[1:], 1)
    )
    spots = F.filter(
        F.transform(F.col("w"), lambda word, i: F.when(word == first, i).otherwise(F.lit(-1))),
        lambda i: (i >= 0) & F.coalesce(same(i), F.lit(False)),
    )
    return F.when(F.array_contains("w", parts[-1]), spots).otherwise(F.array().cast("array<int>"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def template_words(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    rows = [(t, label, word) for t, (label, text) in enumerate(templates) for word in sorted(set(text.split()))]
    return spark.createDataFrame(rows, "template int, label string, word string")


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """License labels of every whole text of ``docs`` (doc_id, text).

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score``. A line whose distinct words hold at least ``percent`` of a template's
    words has its label. ``score`` is 1 with a base phrase, else the best such
    share, else 0. Null and empty texts have no words and no labels. Rows are
    kept one to one, and rows that share a doc_id share what lines of any of them
    add; other columns are ignored. ``templates`` is a short list, held by every
    task.
    """
    spark = docs.sparkSession
    listed = sorted({word for _, text in templates for word in text.split()})
    known = F.array(*[F.lit(word) for word in listed])
    split = with_once(docs.select(F.col("doc_id").cast("long"), "text"), w=words(lowered(F.col("text"))))
    marks = {label: f"p{i}" for i, label in enumerate(PHRASES.values())}
    facts = with_once(
        split.select("doc_id", "w"),
        n_words=F.size("w").cast("long"),
        present=F.array_intersect("w", known),
        **{marks[label]: _places(phrase) for phrase, label in PHRASES.items()},
    ).drop("w")
    table = materialize(facts, "license-facts")
    found = materialize(_template_labels(spark, docs, table, templates, percent), "license-labels")
    added = found.groupBy("doc_id").agg(F.collect_set("label").alias("added"), F.max("share").alias("share"))
    places = F.array_sort(F.concat(*[F.col(p) for p in marks.values()]))
    base = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for label, p in marks.items()]))
    full = table.join(broadcast_if_small(added), "doc_id", "left").select(
        "doc_id", "n_words", places.alias("places"), base.alias("base"), "added", "share"
    )
    return full.select(
        "doc_id", "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0)).cast("long").alias("first_word"),
        F.get("places", F.size("places") - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("added", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _template_labels(spark: SparkSession, docs: DataFrame, table: DataFrame, templates, percent: int) -> DataFrame:
    """(doc_id, label, share): the set-similarity join of blocks with templates."""
    template = template_words(spark, templates)
    counts = table.select(F.explode("present").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")
    ranked = template.join(counts, "word", "left").withColumn("token", order)
    # At most one row per word of the template list: the tokens of each, rarest first.
    sets = ranked.groupBy("template", "label").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    need = F.ceil(F.size("tokens") * percent / F.lit(100)).cast("int")
    sets = materialize(sets.withColumn("need", need), "license-templates")
    prefixes = sets.select(
        "template", "label", "tokens", "need", F.posexplode(F.slice("tokens", 1, F.size("tokens") - F.col("need") + 1)).alias("at", "token")
    ).select("template", "label", "tokens", "need", "at", F.col("token.word").alias("word"))
    prefixes = F.broadcast(prefixes)  # at most the words of the template list
    held = table.select("doc_id", "present", F.explode("present").alias("word")).join(prefixes, "word")
    within = F.size(F.array_intersect("present", F.transform("tokens", lambda t: t["word"])))
    wanted = materialize(held.where(within >= F.col("need")).select("doc_id").distinct(), "license-candidates")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(broadcast_if_small(wanted), "doc_id", "left_semi")
    lines = texts.select("doc_id", F.explode(F.split(lowered(F.col("text")), "\n")).alias("line"))
    blocks = with_once(lines, has=F.array_distinct(words(F.col("line")))).select("doc_id", "has")
    pairs = blocks.select("doc_id", "has", F.explode("has").alias("word")).join(prefixes, "word")
    long_enough = F.size("has") >= F.col("need")  # length filter
    far_enough = F.size("tokens") - F.col("at") >= F.col("need")  # positional filter on the first shared token
    first = F.expr("aggregate(tokens, cast(null as string), (f, t) -> coalesce(f, if(array_contains(has, t.word), t.word, null)))")
    own = pairs.where(long_enough & far_enough & (first == F.col("word")))
    shared = F.size(F.array_intersect("has", F.transform("tokens", lambda t: t["word"])))
    return (
        own.withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
        .groupBy("doc_id", "label").agg(F.max(F.col("shared") / F.size("tokens")).alias("share"))
    )


def oracle(templates=TEMPLATES, percent: int = PERCENT) -> str:
    """The same by comparing every line with every template, as DuckDB SQL."""
    cut = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    places = " || ".join(
        "list_filter(range(len(w)), lambda i: " + " AND ".join(
            f"w[i + {j}] = '{word}'" for j, word in enumerate(phrase.split(), 1)
        ) + ")" for phrase in PHRASES
    )
    base = "list_filter([" + ", ".join(
        "CASE WHEN len(list_filter(range(len(w)), lambda i: " + " AND ".join(
            f"w[i + {j}] = '{word}'" for j, word in enumerate(phrase.split(), 1)
        ) + f")) > 0 THEN '{label}' END" for phrase, label in PHRASES.items()
    ) + "], lambda x: x IS NOT NULL)"
    sets = ", ".join(
        f"('{label}', [{', '.join(repr(w) for w in sorted(set(text.split())))}])" for label, text in templates
    )
    return f"""
WITH t(label, s) AS (VALUES {sets}),
d AS (SELECT doc_id, {low} AS low, {cut.format(low)} AS w FROM documents),
f AS (SELECT doc_id, len(w) AS n_words, {places} AS p, {base} AS base FROM d),
l AS (SELECT doc_id, list_distinct({cut.format('line')}) AS has
      FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS line FROM d)),
m AS (SELECT doc_id, label, len(list_intersect(has, s)) AS k, len(s) AS n FROM l, t WHERE len(has) > 0),
a AS (SELECT doc_id, list(DISTINCT label) AS added, max(CAST(k AS DOUBLE) / n) AS share
      FROM m WHERE k * 100 >= n * {percent} GROUP BY doc_id)
SELECT doc_id, n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(added, []))), ',') AS labels,
       CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM f LEFT JOIN a USING (doc_id)"""
