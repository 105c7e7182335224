"""Phrase collocations, counted losslessly in counting quotient filters.

A word is a number of ``ID_BITS`` + 1 bits: hash bits of its language and itself, or,
for the few words that share those, a number of its own. An n-gram of up to three words
packs into 126 bits, which a Feistel network permutes. The leading bits say which
filter it goes to and its quotient there; all other bits are kept as the remainder, so
nothing is lost and the n-gram can be read back. Tasks count into sorted filters of
bounded size; filters of the same range are merged like sorted lists, adding counters.

Phrases are counted by growing length: a longer one can only be frequent if the
shorter ones inside it are, which a bit array of fixed size tells (its false hits cost
room, never a wrong count).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.urlrules import LOWER, UPPER
from newsloom.operators.lookup import lookup
from newsloom.operators.topk import top_k_per_group
from newsloom.session import broadcast_if_small, fits_in_broadcast, materialize

ID_BITS = 41
HALF = 63  # bits of each half of a packed n-gram: three ids of 42 bits
#: Entries of a filter that a task holds before it passes them on, and that a range of the merge has at most.
ENTRIES = 1 << 20
#: Words whose counts, or (in each of so many languages) whose ids, a task remembers.
WORDS, LANGS = 200_000, 8
#: Bits of the arrays that tell which words and which pairs may be frequent.
FILTER_BITS = 26
#: Bytes of a text that are cut into words at a time.
SLICE = 4 << 20
# Bytes that end a piece, and the mark they become (never a byte of UTF-8).
ENDS, MARK = b".,;:!?\n\x0b\x0c\r", b"\xff"
_BYTES = bytes.maketrans((UPPER + "\t").encode() + ENDS, (LOWER + " ").encode() + b"\n" * len(ENDS))
_U = np.uint64
_MASK = _U((1 << HALF) - 1)


# ------------------------------------------------------------------ packed n-grams

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_ROUNDS = tuple(_U(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i in range(1, 5))


def permute(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two mixed halves for n-grams of word ids (third: 0 for a pair); ``restore`` inverts it."""
    left, right = (first << _U(21)) | (second >> _U(21)), ((second & _U((1 << 21) - 1)) << _U(42)) | third
    for key in _ROUNDS:
        left, right = right, (left ^ _mix(right + key)) & _MASK
    return left, right


def restore(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    for key in reversed(_ROUNDS):
        left, right = (right ^ _mix(left + key)) & _MASK, left
    second = ((left & _U((1 << 21) - 1)) << _U(21)) | (right >> _U(42))
    return left >> _U(21), second, right & _U((1 << 42) - 1)


class Counts(NamedTuple):
    """Distinct n-grams as sorted halves, with a counter each."""

    left: np.ndarray
    right: np.ndarray
    n: np.ndarray

    @classmethod
    def none(cls) -> Counts:
        return cls(np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64))

    @classmethod
    def merged(cls, parts: Iterable[Counts]) -> Counts:
        left, right, n = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(left, kind="stable")
        same = np.diff(left[order]) == 0
        if (same & (np.diff(right[order]) != 0)).any():  # not the same n-gram: both halves decide
            order = np.lexsort((right, left))
        left, right, n = left[order], right[order], n[order]
        first = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])]) if len(left) else np.zeros(0, np.intp)
        return cls(left[first], right[first], np.add.reduceat(n, first) if len(first) else n)


def pack_filter(counts: Counts, lead: int) -> bytes:
    """A counting quotient filter of n-grams that share their first ``lead`` bits.

    Next come the bits of the quotient, as many as give each entry about a slot.
    Occupied quotients and the ends of their runs are bit arrays, remainders are
    kept whole, counters take a byte, or nine from 255 on.
    """
    n = len(counts.n)
    q = min(max(n - 1, 1).bit_length(), HALF - lead)
    rest = HALF - lead - q
    quotient = (counts.left >> _U(rest)) & _U((1 << q) - 1)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient.astype(np.int64)] = True
    ends = np.r_[quotient[1:] != quotient[:-1], True] if n else np.zeros(0, bool)
    width = -(-rest // 8)
    low = (counts.left & _U((1 << rest) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    small = np.minimum(counts.n, 255).astype(np.uint8)
    return b"".join([
        np.asarray([n, lead, q], "<i8").tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
        low.tobytes(), counts.right.astype("<u8").tobytes(), small.tobytes(), counts.n[small == 255].astype("<i8").tobytes(),
    ])


def unpack_filter(data: bytes, lead_bits: int) -> Counts:
    """The n-grams and counters of a filter whose n-grams begin with ``lead_bits``."""
    n, lead, q = np.frombuffer(data, "<i8", 3).tolist()
    rest, at = HALF - lead - q, 24

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    occupied = np.flatnonzero(np.unpackbits(take("u1", -(-(1 << q) // 8)), count=1 << q))
    ends = np.flatnonzero(np.unpackbits(take("u1", -(-n // 8)), count=n))
    quotient = np.repeat(occupied, np.diff(ends, prepend=-1)).astype(_U)
    width = -(-rest // 8)
    low = np.zeros((n, 8), np.uint8)
    low[:, :width] = take("u1", n * width).reshape(n, width)
    left = (_U(lead_bits) << _U(HALF - lead) if lead else _U(0)) | (quotient << _U(rest)) | low.view("<u8").ravel()
    right = take("<u8", n).astype(_U)
    counts = take("u1", n).astype(np.int64)
    many = counts == 255
    counts[many] = take("<i8", int(many.sum()))
    return Counts(left, right, counts)


# ------------------------------------------------------------------ words of texts

def _tokens(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice, with MARK where a piece ends."""
    data = (text or b"").translate(_BYTES).replace(b"\n", b" " + MARK + b" ")
    start = 0
    while start < len(data):
        end = data.find(b" ", start + SLICE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


class _Ids(dict):
    """Ids of the words of a language; 0 for words that cannot be frequent."""

    def __init__(self, lang: bytes, shared: dict[tuple[bytes, bytes], int], frequent: np.ndarray):
        super().__init__({MARK: 0})
        self.lang, self.shared, self.frequent = lang, shared, frequent

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
            self[MARK] = 0
        value = self.shared.get((self.lang, word))
        if value is None:
            value = word_id(self.lang, word)
        place = value & ((1 << FILTER_BITS) - 1)
        value = self[word] = value if self.frequent[place >> 3] >> (place & 7) & 1 else 0
        return value


def word_id(lang: bytes, word: bytes) -> int:
    """As ``_id_column``: a number from 1 to 2 ** ID_BITS."""
    return (xxhash.xxh64_intdigest(lang + b"\0" + word, seed=42) & ((1 << ID_BITS) - 1)) + 1


def _id_column() -> Column:
    key = F.xxhash64(F.concat("lang", F.lit("\0"), "word"))
    return key.bitwiseAND(F.lit((1 << ID_BITS) - 1)) + 1


def _with_lang(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, f`` of all words; a task adds up what it remembers before it passes it on."""

    def rows(held: dict[bytes, Counter]) -> pa.RecordBatch:
        langs = [lang for lang, own in held.items() for _ in own]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(langs, pa.binary()).cast(pa.string()), pa.array([w for own in held.values() for w in own], pa.binary()).cast(pa.string()),
                pa.array([n for own in held.values() for n in own.values()], pa.int64()),
            ],
            ["lang", "word", "f"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = held.setdefault(lang, Counter())
                for words in _tokens(text.as_py()):
                    own.update(words)
                own.pop(MARK, None)
                if len(own) > WORDS or len(held) > WORDS // 100:
                    yield rows(held)
                    held = {}
            if sum(map(len, held.values())) > WORDS:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    counted = _with_lang(docs).mapInArrow(run, "lang string, word string, f long")
    return counted.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _numbered(counts: DataFrame) -> tuple[DataFrame, dict[tuple[bytes, bytes], int]]:
    """``counts`` with an ``id`` that no two words share, and the words that have another than their hash.

    Of words with the same hash all but the first get a number above all hashes. V
    words give about V * V / 2 ** 42 of them, a quarter of a million for a thousand million.
    """
    hashed = counts.withColumn("id", _id_column())
    met = hashed.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = hashed.join(met.select("id"), "id", "left_semi").select("id", "lang", "word").orderBy("id", "lang", "word").collect()
    shared, above = {}, 1 << ID_BITS
    for before, row in zip(rows, rows[1:]):
        if row["id"] == before["id"]:
            above += 1
            shared[row["lang"].encode(), row["word"].encode()] = above
    if not shared:
        return hashed, shared
    spark = counts.sparkSession
    own = spark.createDataFrame([(a.decode(), b.decode(), i) for (a, b), i in shared.items()], "lang string, word string, own long")
    moved = hashed.join(broadcast_if_small(own), ["lang", "word"], "left")
    return moved.withColumn("id", F.coalesce("own", "id")).drop("own"), shared


# ------------------------------------------------------------------ counting phrases

def _bit_array(keys: DataFrame, key: str) -> np.ndarray:
    """Bits at the low ``FILTER_BITS`` of the keys; at most 2 ** (FILTER_BITS - 6) rows reach the driver."""
    place = F.col(key).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def _set_at(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (keys & _U((1 << FILTER_BITS) - 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _grams(ids: np.ndarray, pairs: np.ndarray | None) -> Counts:
    """All pairs of neighbouring words, or, given the bits of frequent pairs, all triples made of two such."""
    first, second = ids[:-1], ids[1:]
    whole = (first != 0) & (second != 0)
    if pairs is None:
        left, right = permute(first[whole], second[whole], np.zeros(int(whole.sum()), _U))
    else:
        likely = whole.copy()
        likely[whole] = _set_at(pairs, permute(first[whole], second[whole], np.zeros(int(whole.sum()), _U))[0])
        at = np.flatnonzero(likely[:-1] & likely[1:])
        left, right = permute(ids[at], ids[at + 1], ids[at + 2])
    return Counts(left, right, np.ones(len(left), np.int64))


def _filters(docs: DataFrame, shared, frequent, pairs, lead: int, entries: int = ENTRIES) -> DataFrame:
    """``range, filter``: what each task has counted, a filter for each value of the first ``lead`` bits."""

    def split(counts: Counts) -> Iterator[pa.RecordBatch]:
        leads = counts.left >> _U(HALF - lead) if lead else np.zeros(len(counts.left), _U)
        cut = np.flatnonzero(np.r_[True, leads[1:] != leads[:-1]]) if len(leads) else np.zeros(0, np.intp)
        for some in np.split(np.arange(len(cut)), range(256, len(cut), 256)):
            ends = [int(cut[i + 1]) if i + 1 < len(cut) else len(leads) for i in some]
            data = [pack_filter(Counts(*(c[int(cut[i]) : e] for c in counts)), lead) for i, e in zip(some, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(leads[cut[some]].astype(np.int64), pa.int64()), pa.array(data, pa.binary())], ["range", "filter"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, _Ids] = {}
        held, waiting, size = Counts.none(), [], 0
        gap = np.zeros(1, _U)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in known and len(known) >= LANGS:
                    known.clear()
                lookup_id = known.setdefault(lang, _Ids(lang, shared.value, frequent.value)).__getitem__
                for words in _tokens(text.as_py()):
                    waiting.append(np.fromiter(map(lookup_id, words), _U, len(words)))
                    size += len(words)
                waiting.append(gap)
                if size > entries:
                    ids = np.concatenate(waiting)
                    for start in range(0, len(ids), entries):  # two more words: those of the n-grams that begin before the cut
                        own = ids[start : start + entries + (1 if pairs is None else 2)]
                        held = Counts.merged([held, _grams(own, pairs and pairs.value)])
                        if len(held.n) > entries:
                            yield from split(held)
                            held = Counts.none()
                    waiting, size = [], 0
        if waiting:
            held = Counts.merged([held, _grams(np.concatenate(waiting), pairs and pairs.value)])
        yield from split(held)

    return _with_lang(docs).mapInArrow(run, "range long, filter binary")


def merge_filters(filters: DataFrame, least: int, entries: int = ENTRIES) -> DataFrame:
    """``w1, w2, w3, a`` of the n-grams that all filters together count ``least`` times or more.

    Filters of a range come one after the other and are merged as they come, so a
    task holds the entries of one range.
    """

    def frequent(counts: Counts) -> pa.RecordBatch:
        some = counts.n >= least
        words = restore(counts.left[some], counts.right[some])
        return pa.RecordBatch.from_arrays(
            [*(pa.array(w.astype(np.int64)) for w in words), pa.array(counts.n[some])], ["w1", "w2", "w3", "a"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, size = None, [Counts.none()], 0
        for batch in batches:
            for value, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if value != current:
                    yield frequent(Counts.merged(parts))
                    current, parts, size = value, [Counts.none()], 0
                parts.append(unpack_filter(data.as_buffer(), value))
                size += len(parts[-1].n)
                if size > entries:
                    parts, size = [Counts.merged(parts)], 0
        yield frequent(Counts.merged(parts))

    return filters.repartition("range").sortWithinPartitions("range").mapInArrow(run, "w1 long, w2 long, w3 long, a long")


def _lead(words: int) -> int:
    """Leading bits that cut the n-grams of so many words into ranges of at most ``ENTRIES``, were all different."""
    return min(HALF - 1, max(0, (max(words, 1) // ENTRIES).bit_length()))


# ------------------------------------------------------------------ scores

def _named(grams: DataFrame, words: DataFrame, small: bool, column: str, name: str) -> DataFrame:
    """``grams`` with the word and count of the id in ``column``, as ``name`` and ``f_name``."""
    table = words.select(F.col("id").alias(column), F.col("word").alias(name), F.col("f").alias(f"f_{name}"), F.col("lang").alias(f"lang_{name}"))
    return grams.join(F.broadcast(table), column) if small else lookup(grams, table, column, "w1" if column != "w1" else "w2")


def _score(l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), in whole numbers of 38 digits."""
    a, l, r = (c.cast("decimal(13,0)") for c in (F.col("a"), l, r))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), l * r)


def collocations(docs: DataFrame, least: int = 10, inside_percent: int = 50, first: int = 2000) -> DataFrame:
    """The best collocations of two or three words of each language.

    ``docs`` has ``text`` and ``lang`` (null: ``und``). Texts are cut into pieces at
    ``.,;:!?`` and line ends, pieces into words at spaces and tabs, A-Z lower-cased; a
    phrase lies in one piece. Candidates occur ``least`` times or more (a). A cut of one
    into two parts that occur l and r times scores floor(1000000 * a * a / (l * r)); the
    lowest score counts, of equals the cut after fewer words. A candidate goes if a
    longer one holds it and occurs in ``inside_percent`` percent of its places or more.
    Returns ``lang, rank, phrase, a, l, r, n, score`` of the ``first`` phrases of each
    language by score, a (both falling) and phrase; n is the number of all its words.
    Null and empty texts have no words; repeated rows count as often as they come;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("lang", "text")
    counted, shared = _numbered(materialize(word_counts(docs), "phrase-words"))
    words = materialize(counted.where(F.col("f") >= least), "phrase-vocabulary") if shared else counted.where(F.col("f") >= least)
    totals = materialize(counted.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    lead = _lead(totals.agg(F.sum("n")).first()[0] or 0)
    known, frequent = spark.sparkContext.broadcast(shared), spark.sparkContext.broadcast(_bit_array(words, "id"))
    two = materialize(merge_filters(_filters(docs, known, frequent, None, lead), least), "phrase-pairs")
    halves = spark.sparkContext.broadcast(_pair_bits(two))
    three = materialize(merge_filters(_filters(docs, known, frequent, halves, lead), least), "phrase-triples")
    return _ranked(two.drop("w3"), three, words, totals, inside_percent, first)


def _pair_bits(two: DataFrame) -> np.ndarray:
    """The bits of the left halves of frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (batch.column(i).to_numpy().astype(_U) for i in range(2))
            left = permute(first, second, np.zeros(len(first), _U))[0]
            yield pa.RecordBatch.from_arrays([pa.array(left.astype(np.int64))], ["left"])

    return _bit_array(two.select("w1", "w2").mapInArrow(run, "left long"), "left")


def _ranked(two: DataFrame, three: DataFrame, words: DataFrame, totals: DataFrame, inside_percent: int, first: int) -> DataFrame:
    small = fits_in_broadcast(words)
    inner = lambda a, b: F.struct(F.col(a).alias("w1"), F.col(b).alias("w2"))
    longer = (
        three.select(inner("w1", "w2").alias("pair"), "a").union(three.select(inner("w2", "w3").alias("pair"), "a"))
        .groupBy("pair").agg(F.max("a").alias("longest"))
    )
    pairs = two.withColumn("pair", inner("w1", "w2")).join(longer, "pair", "left")
    pairs = pairs.where(F.coalesce(100 * F.col("longest") < inside_percent * F.col("a"), F.lit(True))).select("w1", "w2", "a")
    pairs = _named(_named(pairs, words, small, "w1", "x"), words, small, "w2", "y")
    pairs = pairs.select(F.col("lang_x").alias("lang"), "a", F.concat_ws(" ", "x", "y").alias("phrase"), F.col("f_x").alias("l"), F.col("f_y").alias("r"))
    counts = two.select(inner("w1", "w2").alias("head"), F.col("a").alias("f_head"))
    triples = three.withColumns({"head": inner("w1", "w2"), "tail": inner("w2", "w3")})
    triples = lookup(triples, counts, "head", "w3")
    triples = lookup(triples, counts.select(F.col("head").alias("tail"), F.col("f_head").alias("f_tail")), "tail", "w1")
    for column, name in (("w1", "x"), ("w2", "y"), ("w3", "z")):
        triples = _named(triples, words, small, column, name)
    cut = lambda l, r, k: F.struct(_score(F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
    best = F.least(cut("f_x", "f_tail", 1), cut("f_head", "f_z", 2))
    triples = triples.withColumn("best", best).select(
        F.col("lang_x").alias("lang"), "a", F.concat_ws(" ", "x", "y", "z").alias("phrase"), F.col("best.l").alias("l"), F.col("best.r").alias("r")
    )
    scored = pairs.unionByName(triples).withColumn("score", _score(F.col("l"), F.col("r"))).select("lang", "phrase", "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    top = top_k_per_group(scored, ["lang"], order, first, spread=["phrase"])
    return top.join(broadcast_if_small(totals), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def oracle(least: int = 10, inside_percent: int = 50, first: int = 2000) -> str:
    """DuckDB SQL for ``collocations`` over ``documents``."""
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {least}),
inner_ AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS longest
           FROM c, (VALUES (1), (2)) v(i) WHERE k = 3 GROUP BY 1, 2),
cuts AS (SELECT c.lang, c.phrase, c.a, m, array_to_string(ws[1:m], ' ') AS head, array_to_string(ws[m + 1:], ' ') AS tail
         FROM c, (VALUES (1), (2)) v(m) WHERE m < c.k),
s AS (SELECT cuts.*, x.a AS l, y.a AS r, ((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a))::BIGINT AS score,
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, m) AS i FROM s),
k AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score,
             row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
      FROM b LEFT JOIN inner_ USING (lang, phrase) WHERE i = 1 AND (longest IS NULL OR 100 * longest < {inside_percent} * b.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) WHERE rank <= {first}"""
