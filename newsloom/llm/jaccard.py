"""Exact n-gram Jaccard join: tiles of rare shingles, bitmap signatures, sorted arrays.

All shingles stand in one order, rare ones first. Two similar sets have one of their
first shingles in common, so many as a set of their size may lack and one more, and
meet in the tile of that shingle. Any order finds the same pairs; this one, by counts
in hashed buckets, keeps a passage that many documents share from filling a tile.
Pairs from tiles pass the bound on set difference that the bits of their hashed
bitmaps give, and then an exact intersection of sorted arrays.

Texts with equal sets are one node, named by the digest of the set. Only names of
nodes go through tiles, which give each node its leaders, the lowest nodes of its
tiles. A node is compared first with the one it shares most tiles with. Where that
leaves a leader and its members in more than one component, all pairs under it are
compared by their bitmaps, each being moved once per leader and not once per tile.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.components import components
from newsloom.llm.urlrules import MAX_BLOCKS, bloom_filter, possible
from newsloom.llm.workers import released
from newsloom.operators.lookup import lookup
from newsloom.session import broadcast_if_small, materialize

#: Characters whose shingles are made at a time.
PART = 2_000_000
CACHE_WORDS = 250_000
#: Buckets in which shingles are counted, and how many travel in one row.
BUCKETS, BLOCK = 1 << 20, 1 << 12
#: Bits of a bitmap per hash of its set: the wider, the nearer its bound is to the true difference.
WIDTH = 4
MAX_BITS = 1 << 16
#: Members of a leader that are compared in one task.
TILE = 4_096
#: Pairs of a component that a leader gives at first; 16 times as many each further time.
LIKELIEST = 4
#: A tile with more nodes than this (estimated from one text in SAMPLE) finds its leader by a folded minimum.
HOT_ROWS, SAMPLE = 1_000_000, 64
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _WordHashes()


def forget() -> None:
    """Drop the word hashes of this worker. A task's closure would only clear its own copy of them."""
    _words.clear()


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each whole text the sorted distinct 64-bit hashes of its ``k``-word shingles.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text
    with fewer words is one shingle; one without words has none.
    """
    lookup, counts, flat = _words.__getitem__, [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        counts.append(len(words))
        flat.append(np.fromiter(map(lookup, words), dtype=np.uint64, count=len(words)))
    joined = np.concatenate(flat) if flat else np.zeros(0, dtype=np.uint64)
    rolled = joined.copy()
    if len(joined) >= k:
        rolled = joined[: len(joined) - k + 1].copy()
        for i in range(1, k):
            rolled = mix(rolled + _C1) + joined[i : len(joined) - k + 1 + i]
        rolled = mix(rolled)
    out, start = [], 0
    for n, own in zip(counts, flat):
        if n >= k:
            found = np.sort(rolled[start : start + n - k + 1])
            out.append(found[np.r_[True, found[1:] != found[:-1]]])
        elif n:
            digest = xxhash.xxh64_intdigest(own.tobytes(), seed=n)
            out.append(np.asarray([digest], dtype=np.uint64))
        else:
            out.append(own)
        start += n
    return out


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


class Bounds:
    """What sizes say of similar sets."""

    def __init__(self, percent: int):
        self.percent = percent

    def allowed(self, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """The most hashes by which two similar sets of these sizes differ."""
        return (na + nb) * (100 - self.percent) // (100 + self.percent)

    def first(self, n: int) -> int:
        """So many hashes of a set of ``n``, first by an order of all, hold one of any similar set's.

        It is none for a set that is only similar to itself.
        """
        common = -(-n * self.percent // 100)  # at least, of a similar set
        return n - common + 1 if n and not common == n == n * 100 // self.percent else 0

    def tiles(self, sets: list[np.ndarray], levels: np.ndarray) -> list[np.ndarray]:
        """The first hashes of each set, which is sorted, by the level of their bucket and then their value."""
        return [s[np.argsort(levels[_buckets(s)], kind="stable")[: self.first(len(s))]] for s in sets]


def bitmap(hashes: np.ndarray) -> bytes:
    """Parities of hashed bits: two of these differ in no more bits than the sets in hashes."""
    width = 64
    while width < WIDTH * len(hashes) and width < MAX_BITS:
        width *= 2
    bits = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: bytes, width: int) -> bytes:
    """The bitmap of the same set with fewer bits."""
    while len(bits) > width:
        half = len(bits) // 2
        bits = (int.from_bytes(bits[:half], "little") ^ int.from_bytes(bits[half:], "little")).to_bytes(half, "little")
    return bits


def least_difference(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ; the wider one is folded to the other's width."""
    width = min(len(a), len(b))
    a, b = _folded(a, width), _folded(b, width)
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= PART:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _node(digest: bytes, shared: dict[bytes, int]) -> int:
    """The name of a set: half of its digest, or a name of its own if another set has that half."""
    return shared[digest] if digest in shared else int.from_bytes(digest[:8], "little", signed=True)


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """Per row the number, half digest (``node``) and digest of its shingles.

    The bitmap is given with the first text of a set in a task's run of texts. More rows
    have the number of shingles by bucket of these texts, a ``block`` of buckets each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes | None] = {None}
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for start, end in _groups(texts):
                sets = shingle_sets(texts[start:end], k)
                digests = [_digest(s) if len(s) else None for s in sets]
                bits: list[bytes | None] = []
                first = []
                for digest, found in zip(digests, sets):
                    bits.append(None if digest in seen else bitmap(found))
                    if digest not in seen:
                        first.append(found)
                    seen.add(digest)
                if first:
                    counts += np.bincount(_buckets(np.concatenate(first)), minlength=BUCKETS)
                if len(seen) > CACHE_WORDS:
                    seen = {None}
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(start, end - start) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d and _node(d, {}) for d in digests], pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.binary()),
                        pa.nulls(end - start, pa.int32()), pa.nulls(end - start, pa.binary()),
                    ],
                    names,
                )
        blocks = np.minimum(counts, np.iinfo(np.uint16).max).astype("<u2").reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        none = [pa.nulls(len(some), kind) for kind in (*[pa.int64()] * 4, *[pa.binary()] * 2)]
        yield pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int32()), pa.array([blocks[i].tobytes() for i in some], pa.binary())], names)

    schema = "doc_id long, text_hash long, n long, node long, digest binary, bits binary, block int, counts binary"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select("doc_id", "text_hash", "text").mapInArrow(released(run, forget), schema)


def _levels(parts: DataFrame) -> np.ndarray:
    """For each bucket eight times the binary logarithm of its shingles, from the ``block, counts`` of all tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[block] = held.get(block, 0) + np.frombuffer(counts, "<u2").astype(np.int64)
        made = [np.minimum(np.rint(8 * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8).tobytes() for counts in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(made, pa.binary())], ["block", "levels"])

    levels = np.zeros(BUCKETS, np.uint8)
    for row in parts.repartition("block").mapInArrow(add, "block int, levels binary").collect():
        levels[row["block"] * BLOCK :][:BLOCK] = np.frombuffer(row["levels"], np.uint8)
    return levels


def _named(signatures: DataFrame) -> tuple[DataFrame, dict[bytes, int]]:
    """``signatures`` with a ``node`` of its own for each set, and the digests whose name is not their half.

    Of digests with the same half all but the lowest get another name: the first free
    one after it. N sets give about N * N / 2 ** 65 of them.
    """
    met = (
        signatures.where("n > 0").groupBy("node").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
        .where("low != high").select("node")
    )
    rows = signatures.join(met, "node", "left_semi").select("node", "digest").distinct().orderBy("node", "digest").collect()
    taken, shared = {r["node"] for r in rows}, {}
    for before, row in zip(rows, rows[1:]):
        if row["node"] == before["node"]:
            name = int.from_bytes(hashlib.blake2b(bytes(row["digest"]), digest_size=8).digest(), "little", signed=True)
            while name in taken:
                name += 1
            taken.add(name)
            shared[bytes(row["digest"])] = name
    if not shared:
        return signatures, shared
    own = signatures.sparkSession.createDataFrame([(bytearray(d), i) for d, i in shared.items()], "digest binary, own long")
    named = signatures.join(broadcast_if_small(own), "digest", "left")
    return named.withColumn("node", F.coalesce("own", "node")).drop("own"), shared


def _sets(docs: DataFrame, k: int, shared: dict[bytes, int], columns, schema: str) -> DataFrame:
    """What ``columns`` makes of the node names and sets of texts, each set once per task's run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start, end in _groups(texts):
                nodes, sets = [], []
                for found in shingle_sets(texts[start:end], k):
                    digest = _digest(found)
                    if len(found) and digest not in seen:
                        if len(seen) >= CACHE_WORDS:
                            seen.clear()
                        seen.add(digest)
                        nodes.append(_node(digest, shared))
                        sets.append(found)
                yield pa.RecordBatch.from_arrays(columns(nodes, sets), names)

    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select("text").mapInArrow(released(run, forget), schema)


def _tiles(docs: DataFrame, k: int, shared: dict[bytes, int], bounds: Bounds, levels: Broadcast) -> DataFrame:
    def columns(nodes, sets):
        keys = bounds.tiles(sets, levels.value)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        return [pa.array(flat.view(np.int64)), pa.array(np.repeat(np.asarray(nodes, np.int64), [len(own) for own in keys]))]

    return _sets(docs, k, shared, columns, "tile long, node long")


def _arrays(docs: DataFrame, k: int, shared: dict[bytes, int]) -> DataFrame:
    def columns(nodes, sets):
        return [pa.array(nodes, pa.int64()), pa.array([s.tobytes() for s in sets], pa.large_binary()).cast(pa.binary())]

    return _sets(docs, k, shared, columns, "node long, hashes binary")


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by tile and node those of a tile's leader, its first node, with each other node."""
    tile, leader = None, None
    for batch in batches:
        tiles, nodes = (batch.column(i).to_numpy() for i in range(2))
        if not len(tiles):
            continue
        first = np.r_[tile is None or tiles[0] != tile, tiles[1:] != tiles[:-1]]
        heads = nodes[first]
        run = np.cumsum(first)
        leaders = np.r_[np.asarray([leader if leader is not None else 0], np.int64), heads][run]
        tile, leader = int(tiles[-1]), int(leaders[-1])
        other = leaders != nodes
        yield pa.RecordBatch.from_arrays([pa.array(leaders[other]), pa.array(nodes[other])], ["a", "b"])


def _near(docs: DataFrame, k: int, shared: dict[bytes, int], bounds: Bounds, levels: Broadcast) -> DataFrame:
    """(a, b, tiles): nodes b that share so many tiles with their leader a. Rows of a tile are streamed, not held."""
    tiles = _tiles(docs, k, shared, bounds, levels)
    some = docs.where(F.pmod(F.col("text_hash"), F.lit(SAMPLE)) == 0)
    counted = _tiles(some, k, shared, bounds, levels).groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(counted.where(F.col("n") * SAMPLE > HOT_ROWS).select("tile"), "jaccard-hot")
    parts = []
    if not hot.isEmpty():  # their leader is a minimum that folds before the shuffle
        few = broadcast_if_small(hot)
        rows = materialize(tiles.join(few, "tile"), "jaccard-hot-rows")
        lowest = materialize(rows.groupBy("tile").agg(F.min("node").alias("a")), "jaccard-hot-leaders")
        parts.append(rows.join(broadcast_if_small(lowest), "tile").where("a != node").select("a", F.col("node").alias("b")))
        tiles = tiles.join(few, "tile", "left_anti")
    sorted_ = tiles.repartition("tile").sortWithinPartitions("tile", "node")
    parts.append(sorted_.mapInArrow(_led, "a long, b long"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return materialize(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("tiles")), "jaccard-near")


def _facts(nodes: DataFrame, name: str, *columns: str) -> DataFrame:
    return nodes.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])


def _possible(pairs: DataFrame, nodes: DataFrame, bounds: Bounds) -> DataFrame:
    """The pairs (a, b) that sizes and then bitmaps do not rule out."""
    p = bounds.percent
    drawn = lookup(lookup(pairs, _facts(nodes, "a", "n", "bits"), "a", "b"), _facts(nodes, "b", "n", "bits"), "b", "a")
    drawn = drawn.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            allowed = bounds.allowed(batch.column(2).to_numpy(), batch.column(3).to_numpy())
            left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            keep = [least_difference(x, y) <= d for x, y, d in zip(left, right, allowed.tolist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    found = drawn.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(released(run), "a long, b long")
    return materialize(found, "jaccard-possible")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int, shared: dict[bytes, int]) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by intersecting their sorted arrays."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = materialize(nodes.join(ends, "node", "left_semi").select("node", "text_hash"), "jaccard-wanted")
    blocks = MAX_BLOCKS  # a filter of fixed size keeps nearly all other texts from being moved
    texts = wanted.select("text_hash").distinct()
    held = possible(docs.select("text_hash", "text"), "text_hash", bloom_filter(texts, "text_hash", blocks), blocks)
    once = held.join(broadcast_if_small(texts), "text_hash", "left_semi")
    arrays = materialize(_arrays(once, k, shared).join(broadcast_if_small(wanted.select("node")), "node", "left_semi"), "jaccard-arrays")
    both = _facts(arrays, "a", "hashes").join(broadcast_if_small(pairs), "a").join(_facts(arrays, "b", "hashes"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    found = both.select("a", "b", "hashes_a", "hashes_b").mapInArrow(released(run), "a long, b long")
    return materialize(found.distinct(), "jaccard-links")


def _labelled(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``rows`` with the component of column ``name`` so far (itself if alone)."""
    own = found.select(F.col("id").alias(name), F.col("component").alias(f"{name}_c"))
    return rows.join(own, name, "left").withColumn(f"{name}_c", F.coalesce(f"{name}_c", name))


def _crossing(
    near: DataFrame, found: DataFrame, compared: DataFrame, nodes: DataFrame, bounds: Bounds, most: int
) -> tuple[DataFrame, DataFrame]:
    """Pairs under one leader, itself included, that are in different components and that bitmaps do not rule out.

    Two nodes of a tile are both under its leader. The bitmaps are compared where the
    rows of a leader are; only pairs that they do not rule out, and that were not
    ``compared`` before, are left. A few links join what is alike, so of each component
    only the ``most`` likely pairs are given, and those of its partners; leaders with
    more are given too, to be looked at again once those are settled. A leader with more than ``TILE`` members
    has them cut into blocks, and every two of its blocks meet in a task of their own.
    """
    labelled = materialize(_labelled(_labelled(near, found, "a"), found, "b"), "jaccard-labelled")
    sizes = labelled.groupBy("a").agg(
        F.max(F.col("a_c") != F.col("b_c")).alias("open"), F.ceil((F.count(F.lit(1)) + 1) / TILE).cast("int").alias("blocks"), F.first("a_c").alias("a_c")
    )
    several = materialize(sizes.where("open").drop("open"), "jaccard-open")
    members = lookup(labelled.select("a", "b", "b_c"), several.select("a", "blocks"), "a", "b")
    members = members.unionByName(several.select("a", F.col("a").alias("b"), F.col("a_c").alias("b_c"), "blocks"))
    drawn = lookup(members, _facts(nodes, "b", "n", "bits"), "b", "a")
    block = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    dealt = drawn.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = [F.col("a"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    rows = dealt.select(*keys, "block", "b", "b_c", "n_b", "bits_b")
    sorted_ = rows.repartition("a", "low", "high").sortWithinPartitions("a", "low", "high", "n_b", "b")
    given = sorted_.mapInArrow(released(lambda batches: _tile_pairs(batches, bounds, most)), "a long, b long, again long")
    given = materialize(given.distinct(), "jaccard-crossing")
    pairs = given.where("again IS NULL").select("a", "b").join(compared, ["a", "b"], "left_anti")
    return materialize(pairs, "jaccard-pairs"), given.where("again IS NOT NULL").select(F.col("again").alias("a")).distinct()


def _tile_pairs(batches: Iterator[pa.RecordBatch], bounds: Bounds, most: int) -> Iterator[pa.RecordBatch]:
    """The possible pairs of each run of rows with the same leader, low and high block."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        keys = [held.column(i).to_numpy() for i in range(3)]
        cut = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(held) else []
        if len(cut) > 1:
            yield _pairs_of(held.slice(0, int(cut[-1])), cut[:-1], bounds, most)
            held = held.slice(int(cut[-1]))
    if held is not None and len(held):
        yield _pairs_of(held, np.zeros(1, dtype=np.int64), bounds, most)


def _pairs_of(table: pa.Table, cut: np.ndarray, bounds: Bounds, most: int) -> pa.RecordBatch:
    leader, low, high, block, ids, component, n = (table.column(i).to_numpy() for i in range(7))
    bits = table.column(7).to_pylist()
    out: set[tuple[int | None, int | None, int | None]] = set()
    for start, end in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)]):
        own = slice(start, end)
        blocks = block[own] if low[start] != high[start] else None
        found = list(_similar_bits(bits[own], n[own], component[own], blocks, bounds, most))
        if not found:
            continue
        *found, cut_short = zip(*found)
        i, j, spare = map(np.concatenate, found)
        likely = np.zeros(len(i), bool)
        of = np.r_[component[start + i], component[start + j]]  # each pair counts for the components of both ends
        order = np.lexsort((np.r_[j, i], np.r_[i, j], np.r_[spare, spare], of))
        first = np.r_[True, of[order][1:] != of[order][:-1]]
        rank = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        likely[order[rank < most] % len(i)] = True
        if any(cut_short) or not likely.all():
            out.add((None, None, int(leader[start])))
        some = np.flatnonzero(likely)
        for x, y in zip(ids[start + i[some]].tolist(), ids[start + j[some]].tolist()):
            out.add((min(x, y), max(x, y), None))
    return pa.RecordBatch.from_arrays([pa.array([row[c] for row in out], pa.int64()) for c in range(3)], ["a", "b", "again"])


def _similar_bits(
    bits, n, component, blocks, bounds: Bounds, most: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Places of rows, sorted by ``n``, whose sizes and bitmaps allow them to be similar, in different components.

    The third array is how far their bits are from the most allowed, lower for likelier
    pairs. With ``blocks`` rows are also in different blocks. A row gives its ``most``
    likely partners among later rows, and says whether it had more, so that memory
    stays in proportion to rows. Wider bitmaps come after narrower ones, as the width
    goes by ``n``; each width has the later ones folded to it. A fold to four words
    tells most pairs of wide bitmaps apart.
    """
    if (component == component[0]).all():
        return
    widths = np.fromiter(map(len, bits), np.int64, len(bits))
    last = np.searchsorted(n, n * 100 // bounds.percent, side="right")
    for width in np.unique(widths).tolist():
        first = int(np.argmax(widths >= width))
        rows = np.frombuffer(b"".join(_folded(b, width) for b in bits[first:]), np.uint64).reshape(len(bits) - first, -1)
        short = np.bitwise_xor.reduce(rows.reshape(len(rows), -1, 4), axis=1) if width > 32 else None
        for i in np.flatnonzero(widths == width).tolist():
            keep = component[i + 1 : last[i]] != component[i]
            if blocks is not None:
                keep &= blocks[i + 1 : last[i]] != blocks[i]
            at = np.flatnonzero(keep) + i + 1
            if not len(at):
                continue
            allowed = bounds.allowed(n[at], n[i])
            if short is not None:
                near = np.bitwise_count(short[at - first] ^ short[i - first]).sum(axis=1) <= allowed
                at, allowed = at[near], allowed[near]
            spare = np.bitwise_count(rows[at - first] ^ rows[i - first]).sum(axis=1).astype(np.int64) - allowed
            at, spare = at[spare <= 0], spare[spare <= 0]
            more = len(at) > most
            if more:
                likeliest = np.lexsort((at, spare))[:most]
                at, spare = at[likeliest], spare[likeliest]
            if len(at):
                yield np.full(len(at), i), at, spare, more


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component`` of every row of ``docs`` (doc_id, text).

    Rows whose texts are linked by similar sets (see ``join``) have the same
    ``component``; it is null for texts without shingles. ``text_hash`` is Spark's
    xxhash64 of the text. A row is judged by its text alone, so rows that repeat a
    doc_id, or have none, are compared like all others.
    """
    bounds = Bounds(percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    signatures = materialize(_signatures(rows, k), "jaccard-signatures")
    levels = rows.sparkSession.sparkContext.broadcast(_levels(signatures.where("block IS NOT NULL").select("block", "counts")))
    named, shared = _named(signatures.where("block IS NULL").drop("block", "counts"))
    some = named.where("n > 0")
    picked = F.max(F.struct(F.col("bits").isNotNull(), "text_hash", "bits")).alias("one")
    nodes = materialize(
        some.groupBy("node").agg(F.max("n").alias("n"), picked).select("node", "n", "one.text_hash", "one.bits"), "jaccard-nodes"
    )
    near = _near(rows, k, shared, bounds, levels)
    closest = near.groupBy("b").agg(F.max_by("a", F.struct("tiles", -F.col("a"))).alias("a"))  # one pair a node links most copies
    likely = _possible(closest.select("a", "b"), nodes, bounds)
    links = _verified(likely, rows, nodes, k, percent, shared)
    found = components(links)
    compared, most = likely, LIKELIEST
    while True:
        rest, again = _crossing(near, found, compared, nodes, bounds, most)
        last = again.isEmpty()
        if not rest.isEmpty():
            links = links.unionByName(_verified(_possible(rest, nodes, bounds), rows, nodes, k, percent, shared))
            found = components(links)
        if last:
            break
        near = near.join(broadcast_if_small(again), "a", "left_semi")
        compared, most = compared.unionByName(rest), 16 * most
    linked = found.select(F.col("id").alias("node"), "component")
    given = named.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    return lookup(given, nodes.select("node").join(linked, "node", "left"), "node", "doc_id", "left").select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("component", "node").alias("component")
    )


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Group ``docs`` (doc_id, text) by Jaccard similarity of their ``k``-word shingles.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets.
    Returns ``doc_id, n_shingles, component_id`` of every row: the lowest doc_id that
    links reach, the row's own included. Null and empty texts, and texts of white
    space, have no shingles and stay alone. Each row is a document: rows that repeat a
    doc_id are linked by their own texts, and rows without one are linked like others
    (their component_id is null only if no row they reach has an id). Other columns
    are ignored, an empty table gives no rows.
    """
    rows = materialize(classes(docs, k, percent), "jaccard-classes")
    lowest = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("lowest"))
    return lookup(rows, lowest, "component", "doc_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id")
    )
