"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

A window that is similar to an item shares shingles with it. Slid right to the
first of them it loses none, so the windows that start at a shared shingle, or
last in the text, hold the most similar one wherever the parts of the item stand.
Those with enough shared shingles to reach the threshold get fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.once import with_once
from newsloom.session import broadcast_if_small, materialize

SHINGLE = 5
PERCENT = 80
#: Bits by which fingerprints may differ. Similar windows (80 %) differ in 10 of 64 on average.
RADIUS = 24


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(words_column: str, k: int = SHINGLE) -> Column:
    """Hashes of all runs of ``k`` words, in order; none for fewer words."""
    w = F.col(words_column)
    n = F.size(w)
    hashed = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(n >= k, hashed).otherwise(F.array().cast("array<bigint>"))


def with_shingles(rows: DataFrame, key: str, k: int = SHINGLE) -> DataFrame:
    """(key, hashes) of every whole text."""
    split = with_once(rows.select(key, "text"), w=words(F.col("text"))).select(key, "w")
    return with_once(split, hashes=shingles("w", k)).select(key, "hashes")


def fingerprint(column: str) -> Column:
    """64-bit SimHash: a bit is set if most shingles, with their multiplicity, have it."""
    ones = f"aggregate({column}, 0, (s, h) -> s + cast(shiftrightunsigned(h, b) & 1L AS int))"
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(cast(2 * {ones} > size({column}) AS bigint), b))"
    )


def _blocks(fingerprint_column: str, radius: int) -> Column:
    """(block, bits) of ``radius`` + 1 blocks: within the radius one of them is the same."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    parts = [
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint_column, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ]
    return F.array(*parts)


def _common() -> Column:
    """Shingles that window and item share, with multiplicity."""
    return F.expr(
        "aggregate(array_intersect(w_hashes, i_hashes), 0, (s, h) -> s + least("
        "size(filter(w_hashes, x -> x = h)), size(filter(i_hashes, x -> x = h))))"
    )


def _last_common() -> Column:
    """Place of the last shingle of the window that adds to the common ones.

    A shingle adds to them until the item's multiplicity of it is used up.
    """
    return F.expr(
        "array_max(filter(sequence(0, size(w_hashes) - 1), j -> array_contains(i_hashes, w_hashes[j]) and "
        "size(filter(slice(w_hashes, 1, j + 1), x -> x = w_hashes[j])) <= size(filter(i_hashes, x -> x = w_hashes[j]))))"
    )


def leaks(
    docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS
) -> DataFrame:
    """Where ``docs`` (doc_id, text) hold an item of ``benchmark`` (item_id, text).

    Returns ``doc_id, item_id, start_word, similarity``: for each pair the most
    similar item-sized window (the first of equals), if its weighted Jaccard
    similarity (shingles of ``k`` words, weight is multiplicity) reaches
    ``percent``. Null and empty texts and items of fewer than ``k`` words match
    nothing. Repeated rows count once; other columns are ignored.
    """
    items = materialize(
        with_shingles(benchmark.dropDuplicates(["item_id"]), "item_id", k).where(F.size("hashes") > 0)
        .withColumn("i_print", fingerprint("hashes")).withColumnRenamed("hashes", "i_hashes"),
        "leaks-items",
    )
    places = items.select("item_id", F.size("i_hashes").alias("n"), F.explode(F.array_distinct("i_hashes")).alias("h"))
    found = with_shingles(docs, "doc_id", k).select(
        "doc_id", F.xxhash64("hashes").alias("version"), F.size("hashes").alias("m"), F.posexplode("hashes").alias("pos", "h")
    )
    # Rows that share a doc_id but not the text are told apart by ``version``.
    shared = found.join(broadcast_if_small(places), "h").groupBy("doc_id", "version", "item_id", "m", "n").agg(
        F.array_sort(F.collect_set("pos")).alias("spots")
    )
    # A window of least(m, n) shingles reaches the threshold with so many common ones, and has no more than shared spots.
    need = F.ceil((F.least("m", "n") + F.col("n")) * percent / F.lit(100 + percent) - 1e-9).cast("int")
    last = F.greatest(F.lit(0), F.col("m") - F.col("n"))
    starts = F.transform("spots", lambda pos, i: F.struct(
        F.least(last, pos).alias("start"),
        F.when(i > 0, F.get("spots", i - 1)).otherwise(F.lit(-1)).alias("before"),
        F.get("spots", i + F.col("need") - 1).alias("reach"),
    ))
    windows = materialize(
        shared.withColumn("need", need).where(F.size("spots") >= F.col("need"))
        .select("doc_id", "version", "item_id", "n", F.inline(starts))
        .where((F.col("before") < F.col("start")) & (F.col("reach") < F.col("start") + F.col("n")))
        .drop("reach"),
        "leaks-windows",
    )
    holders = broadcast_if_small(windows.select("doc_id").distinct())
    texts = with_shingles(docs.join(holders, "doc_id", "left_semi"), "doc_id", k).withColumn("version", F.xxhash64("hashes"))
    cut = texts.join(windows, ["doc_id", "version"]).select(
        "doc_id", "version", "item_id", "start", "before", F.slice("hashes", F.col("start") + 1, F.col("n")).alias("w_hashes")
    )
    printed = materialize(
        with_once(cut, w_print=fingerprint("w_hashes")).distinct(), "leaks-prints"
    )
    own = printed.select("doc_id", "version", "item_id", "start", "w_print", F.inline(_blocks("w_print", radius)))
    theirs = items.select("item_id", "i_print", F.inline(_blocks("i_print", radius)))
    near = (
        own.join(broadcast_if_small(theirs), ["item_id", "block", "bits"])
        .where(F.bit_count(F.col("w_print").bitwiseXOR(F.col("i_print"))) <= radius)
        .select("doc_id", "version", "item_id", "start").distinct()
    )
    both = printed.join(near, ["doc_id", "version", "item_id", "start"]).join(
        broadcast_if_small(items.select("item_id", "i_hashes")), "item_id"
    )
    scored = with_once(both, common=_common()).withColumn(
        "total", F.size("w_hashes") + F.size("i_hashes") - F.col("common")
    )
    kept = scored.where(F.col("common") * 100 >= F.col("total") * percent)
    # Slid left as far as it keeps its common shingles, a window is the first of its equals.
    first = F.greatest(
        F.lit(0), F.col("before") + 1, F.col("start") + _last_common() + 1 - F.size("i_hashes")
    )
    first = F.when(F.size("w_hashes") < F.size("i_hashes"), F.col("start")).otherwise(first)
    best = F.max(F.struct((F.col("common") / F.col("total")).alias("similarity"), (-first).alias("before")))
    return kept.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", (-F.col("best.before")).alias("start_word"), F.col("best.similarity").alias("similarity")
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item. Rows with a null doc_id stay."""
    ids = materialize(leaks(docs, benchmark).select("doc_id").distinct(), "leaks-ids")
    return docs.join(broadcast_if_small(ids), "doc_id", "left_anti")
