"""Language identification with interpolated Kneser-Ney character models.

Counts of character n-grams are gathered from every training row. The models of
all languages share one sorted hash array per order (one column of log
probabilities per language), so a text is looked up once for all of them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import materialize

ORDER = 4
#: Characters scored or counted at a time; a longer text goes in parts of this size.
PART = 500_000
#: Temperatures that are tried, and the parts of a log loss that are summed.
TEMPERATURES, UNIT = np.geomspace(0.01, 2.0, 40), 1 << 20
#: Share of training rows whose cross-entropy may lie above the rejection bound.
REJECTED = 0.005
EDGE, SPACE, OTHER = 1, 32, 0xFFFE
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so the product is a bijection
_characters: list[np.ndarray] = []


def character_table() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else a space."""
    if not _characters:
        table = np.full(sys.maxunicode + 1, SPACE, dtype=np.uint16)
        for code in range(sys.maxunicode + 1):
            if chr(code).isalpha():
                low = ord(chr(code).lower()[0])
                table[code] = low if low < OTHER else OTHER
        _characters.append(table)
    return _characters[0]


def parts(texts: list[str | None], size: int = PART) -> Iterator[list[tuple[int, str]]]:
    """Groups of (row, text) with about ``size`` characters; longer texts are cut."""
    group, total = [], 0
    for row, text in enumerate(texts):
        for start in range(0, len(text or ""), size):
            piece = text[start : start + size]
            group.append((row, piece))
            total += len(piece)
            if total >= size:
                yield group
                group, total = [], 0
    if group:
        yield group


def grams(group: list[tuple[int, str]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of normalised texts (16 bits a character) and the row of each.

    Letters are lower-cased, runs of anything else become one space, and edge
    marks stand before each text.
    """
    edge = "\x00" * (order - 1)
    joined = edge + edge.join(text for _, text in group)
    codes = character_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    lengths = np.fromiter((len(t) + order - 1 for _, t in group), dtype=np.int64, count=len(group))
    rows = np.repeat(np.fromiter((r for r, _ in group), dtype=np.int64, count=len(group)), lengths)
    starts = np.cumsum(lengths) - lengths
    for k in range(order - 1):
        codes[starts + k] = EDGE
    space = codes == SPACE
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(space[1:] & (space[:-1] | (codes[:-1] == EDGE)))
    codes, rows = codes[keep].astype(np.uint64), rows[keep]
    key = np.zeros(len(codes) - order + 1, dtype=np.uint64)
    for k in range(order):
        key = (key << np.uint64(16)) | codes[k : k + len(key)]
    inside = codes[order - 1 :] != EDGE
    return key[inside], rows[order - 1 :][inside]


@dataclass
class HashArray:
    """Sorted hashes with one row of values each, found by their leading bits."""

    hashes: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    shift: int
    longest: int

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> HashArray:
        hashes = keys * _MIX
        order = np.argsort(hashes)
        hashes = hashes[order]
        bits = max(4, int(len(keys)).bit_length() + 1)
        shift = 64 - bits
        starts = np.searchsorted(hashes >> np.uint64(shift), np.arange((1 << bits) + 1, dtype=np.uint64))
        longest = int(np.diff(starts).max(initial=0))
        padded = np.concatenate([hashes, np.zeros(longest + 1, dtype=np.uint64)])
        return cls(padded, values[order].astype(np.float32), starts.astype(np.int32), shift, longest)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is missing."""
        hashes = keys * _MIX
        bucket = (hashes >> np.uint64(self.shift)).astype(np.int64)
        first, end = self.starts[bucket], self.starts[bucket + 1]
        found = np.where((self.hashes[first] == hashes) & (first < end), first, -1)
        for step in range(1, self.longest):
            open_ = np.flatnonzero((found < 0) & (first + step < end))
            if not len(open_):
                break
            at = first[open_] + step
            hit = self.hashes[at] == hashes[open_]
            found[open_[hit]] = at[hit]
        return found


def _suffix(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << (16 * order)) - 1)


@dataclass
class LanguageModels:
    """Kneser-Ney models: per order the seen n-grams, and the back-off weights of contexts."""

    languages: list[str]
    grams: list[HashArray]  # order 1, 2, ...
    contexts: list[HashArray]  # contexts of order 2, 3, ...
    unseen: np.ndarray
    temperature: float = 1.0
    bound: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> LanguageModels:
        """``counts``: for each language its n-grams of the highest order and their counts."""
        languages = sorted(counts)
        levels = []  # per language: order -> (keys, counts)
        for language in languages:
            keys, n = counts[language]
            own = {order: (keys, n.astype(np.float64))}
            for k in range(order - 1, 0, -1):
                lower, types = np.unique(_suffix(own[k + 1][0], k), return_counts=True)
                own[k] = (lower, types.astype(np.float64))
            levels.append(own)
        symbols = max(2, len(np.unique(np.concatenate([own[1][0] for own in levels]))) + 1)
        models = cls(languages, [], [], np.zeros(len(languages)))
        for k in range(1, order + 1):
            union = np.unique(np.concatenate([own[k][0] for own in levels]))
            heads = np.unique(union >> np.uint64(16))
            back = np.zeros((len(heads), len(languages)))
            share = np.zeros((len(union), len(languages)))
            for at, own in enumerate(levels):
                keys, n = own[k]
                ones, twos = (n == 1).sum(), (n == 2).sum()
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                own_heads, inverse = np.unique(keys >> np.uint64(16), return_inverse=True)
                total = np.bincount(inverse, n)
                types = np.bincount(inverse)
                back[np.searchsorted(heads, own_heads), at] = np.log(discount * types / total)
                share[np.searchsorted(union, keys), at] = np.maximum(n - discount, 0) / total[inverse]
            if k == 1:
                models.unseen = back[0] - np.log(symbols)
                log_p = np.log(share + np.exp(models.unseen))
            else:
                weight = back[np.searchsorted(heads, union >> np.uint64(16))]
                log_p = np.log(share + np.exp(weight + models._score(_suffix(union, k - 1), k - 1)))
                models.contexts.append(HashArray.build(heads, back))
            models.grams.append(HashArray.build(union, log_p))
        return models

    def _score(self, keys: np.ndarray, order: int) -> np.ndarray:
        array = self.grams[order - 1]
        found = array.find(keys)
        out = array.values[found]  # of a missing key: any row, replaced below
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if order == 1:
                out[missing] = self.unseen
            else:
                heads = self.contexts[order - 2]
                at = heads.find(keys[missing] >> np.uint64(16))
                weight = np.where((at >= 0)[:, None], heads.values[at], 0.0)
                out[missing] = weight + self._score(_suffix(keys[missing], order - 1), order - 1)
        return out

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the mean surprise of a character, and the characters that count.

        Only texts with a letter have characters that count.
        """
        sums = np.zeros((len(texts), len(self.languages)))
        n = np.zeros(len(texts), dtype=np.int64)
        letters = np.zeros(len(texts), dtype=bool)
        for group in parts(texts):
            keys, rows = grams(group, len(self.grams))
            if not len(keys):
                continue
            cut = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            log_p = self._score(keys, len(self.grams))
            own = rows[cut]
            sums[own] -= np.add.reduceat(log_p, cut, axis=0, dtype=np.float64)
            n[own] += np.diff(np.r_[cut, len(keys)])
            letters[own] |= np.logical_or.reduceat(_suffix(keys, 1) != SPACE, cut)
        n[~letters] = 0
        return sums / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        """The language of lowest cross-entropy, its probability, and whether it is beyond the bound."""
        entropy, n = self.cross_entropy(texts)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(best)), best]
        odds = np.exp((lowest[:, None] - entropy) / self.temperature)
        score = 1.0 / odds.sum(axis=1)
        beyond = lowest > (np.inf if self.bound is None else self.bound[best])
        known = n > 0
        return {
            "lang_pred": [self.languages[b] if k else "und" for b, k in zip(best, known)],
            "score": np.where(known, score, 0.0).tolist(),
            "cross_entropy": [float(x) if k else None for x, k in zip(lowest, known)],
            "rejected": (beyond | ~known).tolist(),
        }


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all ``rows`` (lang, text); summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def fold(pairs):
            keys, inverse = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([n for _, n in pairs])).astype(np.int64)

        def out(language):
            keys, n = fold(held.pop(language))
            return pa.RecordBatch.from_arrays(
                [pa.array([language] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)],
                ["lang", "gram", "n"],
            )

        for batch in batches:
            by: dict[str, list[str | None]] = {}
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(language, []).append(text)
            for language, texts in by.items():
                for group in parts(texts):
                    keys = np.sort(grams(group, order)[0])
                    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
                    own = held.setdefault(language, [])
                    own.append((keys[cut], np.diff(np.r_[cut, len(keys)])))
                    if len(own) >= 16:
                        held[language] = [fold(own)]
                        if len(held[language][0][0]) > 1_000_000:
                            yield out(language)
        for language in list(held):
            yield out(language)

    made = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return made.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, order: int = ORDER) -> LanguageModels:
    """Models of every ``lang`` in ``rows`` (doc_id, lang, text); rows without either value do not count.

    All rows are counted, and all their n-grams are in the model: it grows with the
    different n-grams of the corpus. Temperature and rejection bound are fitted on all
    rows as well, which are scored once more for that.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    kept = materialize(gram_counts(rows, order), "language-counts")
    languages = [r["lang"] for r in kept.select("lang").distinct().collect()]
    counts = {}
    for lang in languages:
        table = kept.where(F.col("lang") == lang).select("gram", "n").toArrow()
        if len(table):
            keys = table.column("gram").to_numpy().view(np.uint64)
            by = np.argsort(keys)
            counts[lang] = keys[by], table.column("n").to_numpy()[by]
    if not counts:
        return LanguageModels([], [], [], np.zeros(0))
    return _calibrated(LanguageModels.fit(counts, order), rows)


def _places(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of ``values``; of whole numbers made so, the values."""
    bits = values.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def _own_entropies(rows: DataFrame, models: LanguageModels) -> DataFrame:
    """``lang, place`` of each row with characters that count: the place of its language's cross-entropy.

    One more row a task has in ``losses``, for each of ``TEMPERATURES``, the sum of the log
    losses of its rows, in whole 2^-20, so that the sum over all tasks is exact.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        losses = np.zeros(len(TEMPERATURES), np.int64)
        numbers = {name: i for i, name in enumerate(shared.value.languages)}
        for batch in batches:
            entropy, n = shared.value.cross_entropy(batch.column(1).to_pylist())
            entropy, names = entropy[n > 0], batch.column(0).filter(pa.array(n > 0)).to_pylist()
            if not names:
                continue
            at = np.asarray([numbers[name] for name in names])
            own, lowest = entropy[np.arange(len(at)), at], entropy.min(axis=1)
            for i, t in enumerate(TEMPERATURES):
                loss = (own - lowest) / t + np.log(np.exp((lowest[:, None] - entropy) / t).sum(axis=1))
                losses[i] += np.rint(loss * UNIT).astype(np.int64).sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(_places(own), pa.int64()), pa.nulls(len(at), pa.list_(pa.int64()))], columns
            )
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([losses.tolist()], pa.list_(pa.int64()))], columns)

    columns = ["lang", "place", "losses"]
    return rows.select("lang", "text").mapInArrow(run, "lang int, place long, losses array<long>")


def _of_rank(places: DataFrame, wanted: list[tuple[int, int]], first: dict[tuple[int, int], int]) -> list[int]:
    """For each (lang, rank) the place with so many lower ones, equal ones in any order, among those of its language.

    16 bits of it are settled in a pass that counts rows by them; ``first`` is the first
    pass, rows by language and highest bits.
    """
    heads: list[int | None] = [None] * len(wanted)
    ranks = [rank for _, rank in wanted]
    for shift in (48, 32, 16, 0):
        counts = first
        if shift < 48:
            open_ = sorted({(lang, head) for (lang, _), head in zip(wanted, heads)})
            some = places.sparkSession.createDataFrame(open_, "own int, head long")
            met = places.join(F.broadcast(some), (F.col("lang") == F.col("own")) & (F.shiftright("place", shift + 16) == F.col("head")))
            counts = _counts(met, shift)
        under: dict[tuple[int, int | None], list[tuple[int, int]]] = {}
        for (lang, head), n in sorted(counts.items()):
            under.setdefault((lang, head >> 16 if shift < 48 else None), []).append((head, n))
        for i, (lang, _) in enumerate(wanted):
            for head, n in under[lang, heads[i]]:
                if ranks[i] < n:
                    heads[i] = head
                    break
                ranks[i] -= n
    return heads


def _counts(places: DataFrame, shift: int) -> dict[tuple[int, int], int]:
    """Rows by language and the bits of their place from ``shift`` on; at most 2^16 a language for given higher bits."""
    found = places.groupBy("lang", F.shiftright("place", shift).alias("head")).agg(F.count(F.lit(1)).alias("n"))
    return {(r["lang"], r["head"]): r["n"] for r in found.collect()}


def _calibrated(models: LanguageModels, rows: DataFrame) -> LanguageModels:
    """``models`` with temperature and rejection bounds of all ``rows`` (lang, text)."""
    models.bound = np.full(len(models.languages), np.inf)
    table = materialize(_own_entropies(rows, models), "language-entropies")
    places = table.where("place IS NOT NULL").select("lang", "place")
    first = _counts(places, 48)
    if not first:
        return models
    losses = table.select(F.posexplode("losses").alias("i", "loss")).groupBy("i").agg(F.sum("loss").alias("loss"))
    best = min((r["loss"], r["i"]) for r in losses.collect())[1]
    models.temperature = float(TEMPERATURES[best])
    rows_of: dict[int, int] = {}
    for (lang, _), n in first.items():
        rows_of[lang] = rows_of.get(lang, 0) + n
    wanted, shares = [], []
    for lang, n in sorted(rows_of.items()):
        below, share = divmod((n - 1) * (1 - REJECTED), 1)
        wanted += [(lang, int(below)), (lang, min(int(below) + 1, n - 1))]
        shares.append(share)
    found = _places(np.asarray(_of_rank(places, wanted, first), np.int64)).view(np.float64).reshape(-1, 2)
    for lang, share, pair in zip(sorted(rows_of), shares, found):
        models.bound[lang] = np.quantile(pair, share)
    return models


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` of ``docs`` (doc_id, text).

    Null texts and texts without a letter, or any text when nothing was learned,
    are ``und`` with score 0 and rejected. ``rejected`` marks texts whose
    cross-entropy lies above nearly all of their language's training rows. A
    text is scored whole, in parts of ``PART`` characters that each begin anew.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if shared.value.languages:
                got = shared.value.predict(texts)
            else:
                n = len(texts)
                got = {"lang_pred": ["und"] * n, "score": [0.0] * n, "cross_entropy": [None] * n, "rejected": [True] * n}
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(got["lang_pred"], pa.string()), pa.array(got["score"], pa.float64()),
                    pa.array(got["cross_entropy"], pa.float64()), pa.array(got["rejected"], pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"
    )
