"""URL rules: a blocked Bloom filter, then an exact hash join on canonical keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.lookup import lookup
from newsloom.session import fits_in_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Blocks of four 64-bit words; more listed keys than about 16 a block only let more false hits pass.
MAX_BLOCKS = 1 << 16
WORDS = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """One bit of a word: 64 places from six bits of a second hash."""
    place = F.shiftrightunsigned(F.xxhash64(key, F.lit(7)), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row per block that has a key: ``block`` and its words, each with one bit per key."""
    bits = [F.bit_or(_bit(F.col(key), i)).alias(f"w{i}") for i in range(WORDS)]
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(*bits)


def possible(rows: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key may be in the filter. At most ``blocks`` rows of five numbers are broadcast."""
    rows = rows.withColumn("block", _block(F.col(key), blocks))
    held = rows.join(F.broadcast(bloom), "block")
    for i in range(WORDS):
        held = held.where(F.col(f"w{i}").bitwiseAND(_bit(F.col(key), i)) != 0)
    return held.drop("block", *[f"w{i}" for i in range(WORDS)])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (page_id, url).

    ``rules`` has ``host``, ``path``, ``verdict``. A rule fits its host and all
    subdomains if the path of the URL starts with the rule's; the longest rule
    wins, of equals the one with the longer host, then the later text. Its text is
    host and path. Rows with a null in a rule do not count; a rule listed with two
    verdicts is ``block`` if one of them is. Without a rule the verdict is
    ``default``. Null urls and urls without ``://`` have empty host and path. Rows
    are kept one to one, repeated ones too; other columns are ignored.

    Each URL gives one key for each shape of rule (labels of the host, length of
    the path), of which a list has few however long it is. Keys that the Bloom
    filter lets pass are joined with the rules; copies fold before that.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    listed = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.max(F.col("verdict") == "block").alias("blocked"), F.max("verdict").alias("other"))
        .select(
            F.concat("host", "path").alias("key"), F.length("host").alias("host_length"),
            F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"),
            F.when(F.col("blocked"), F.lit("block")).otherwise(F.col("other")).alias("verdict"),
        )
    )
    shapes = [(r["labels"], r["path_length"], r["n"]) for r in listed.groupBy("labels", "path_length").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not shapes:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = min(MAX_BLOCKS, max(16, 1 << (sum(n for _, _, n in shapes) // 16).bit_length()))
    keys = F.array(*[
        F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, length))
        for labels, length, _ in sorted(shapes)
    ])
    candidates = urls.select("host", "path", F.explode(keys).alias("key"))
    hits = possible(candidates, "key", bloom_filter(listed, "key", blocks), blocks).distinct()
    table = listed.select("key", "host_length", "verdict")
    found = hits.join(F.broadcast(table), "key") if fits_in_broadcast(table) else lookup(hits, table, "key", "path")
    best = found.groupBy("host", "path").agg(
        F.max(F.struct(F.length("key").alias("length"), "host_length", F.col("key").alias("rule"), "verdict")).alias("best")
    )
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
