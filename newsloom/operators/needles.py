"""Texts that contain any of a long list of needles, without comparing all with all.

Each needle is looked for where its rarest q-gram is: the grams of the texts that some
needle has are counted, a needle is listed under the one that fewest texts have, and
only texts with that gram are tested for the whole needle. A needle with a gram that
no text has is in none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.lookup import lookup
from newsloom.session import broadcast_if_small, materialize

Q = 3


def grams(text: Column, q: int) -> Column:
    """The different runs of ``q`` characters of a text; none if it is shorter."""
    letters = F.split(text, "")
    last = F.char_length(text) - q
    run = lambda i: F.concat(*[F.get(letters, i + j) for j in range(q)])
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), run))).otherwise(F.array().cast("array<string>"))


def matches(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """``(text, needle)``: every different text with every different needle that it contains.

    Null and empty needles are in no text. Repeats are folded first on both sides.
    """
    listed = needles.select(F.col(needle).alias("needle")).where(F.char_length("needle") > 0).distinct()
    listed = materialize(listed.withColumn("q", F.least(F.char_length("needle"), F.lit(Q))), "needles")
    sizes = [r["q"] for r in listed.select("q").distinct().collect()]  # at most Q
    given = texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    if not sizes:
        return given.select("text", F.lit(None).cast("string").alias("needle")).where(F.lit(False))
    own = F.concat(*[F.when(F.col("q") == q, grams(F.col("needle"), q)).otherwise(F.array().cast("array<string>")) for q in sizes])
    asked = materialize(listed.withColumn("grams", own).select("needle", F.size("grams").alias("n"), F.explode("grams").alias("gram")), "needle-grams")
    wanted = broadcast_if_small(asked.select("gram").distinct())
    held = given.select("text", F.explode(F.concat(*[grams(F.col("text"), q) for q in sizes])).alias("gram"))
    held = materialize(held.join(wanted, "gram", "left_semi"), "text-grams")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    rarest = (
        asked.join(counts, "gram").groupBy("needle", "n")
        .agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("texts", "gram")).alias("least"))
        .where("found = n").select("needle", F.col("least.gram").alias("gram"))
    )
    candidates = held.join(broadcast_if_small(materialize(rarest, "needle-index")), "gram")
    return candidates.where(F.col("text").contains(F.col("needle"))).select("text", "needle").distinct()


def with_contains(rows: DataFrame, text: str, needles: DataFrame, needle: str, out: str) -> DataFrame:
    """``rows`` with ``out``: whether the text contains one of ``needles``; false for a null text."""
    found = matches(rows, text, needles, needle).select(F.col("text").alias(text)).distinct()
    hit = materialize(found.withColumn(out, F.lit(True)), "needle-hits")
    order = [*rows.columns, out]
    met = lookup(rows, hit, text, text, "left")
    return met.withColumn(out, F.coalesce(F.col(out), F.lit(False))).select(*order)
