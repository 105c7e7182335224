"""Toxicity: a gapped-subsequence string kernel, Nyström landmarks, a linear SVM.

The kernel compares words through their letter triples; a triple may have gaps,
each letter of gap costs ``DECAY``. Insults with inserted or separating
characters keep most of their triples and so stay close to the plain word. A
text is described by its nearest word to each landmark.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.workers import released

SYMBOLS = 32
DECAY = 0.7
SPAN = 6  # letters from the first to the last of a triple, at most
LONGEST = 24  # longer words are compared in windows of this size, half overlapping
#: A word that is less similar than this to every landmark counts as not similar at all.
FLOOR = 0.45
#: Words this near to a landmark count for the share of the text that is near it.
CLOSE, SHORT, DENSE = 0.6, 20, 25.0
#: Bounds of the labelled sample that landmarks and classifier are fitted on.
MAX_TOXIC, MAX_CLEAN = 2_500, 5_000
LANDMARKS = 24
#: Tokens that a worker knows at most, and pieces of words that are compared at a time: both bound its memory.
CACHE_TOKENS, PIECES = 100_000, 1_000
SPELT = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")

_PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def plain(token: str) -> str:
    """The letters of a token, lower-cased."""
    return token if token.isalpha() and token.islower() else "".join(filter(str.isalpha, token)).lower()


def tokens(text: str | None) -> list[str]:
    """White-space tokens; three or more single characters in a row make one token too."""
    if not text:
        return []
    found = text.split()
    if min(map(len, found), default=2) == 1:
        found += ["".join(m.group().split()) for m in SPELT.finditer(text)]
    return found


def windows(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    step = LONGEST // 2
    return [word[i : i + LONGEST] for i in range(0, len(word) - step, step)]


def _entries(words: list[str], used: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Every gapped letter triple of the words: word, triple, weight; only ``used`` triples if given."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    flat = np.where((flat >= 97) & (flat <= 122), flat - 97, 26 + flat % 6)
    width = int(lengths.max(initial=0))
    grid = np.zeros((len(words), width), dtype=np.int64)
    grid[np.arange(width)[None, :] < lengths[:, None]] = flat
    rows, features, weights = [], [], []
    for a, b in _PATTERNS:
        if b >= width:
            continue
        feature = (grid[:, : width - b] * SYMBOLS + grid[:, a : width - b + a]) * SYMBOLS + grid[:, b:]
        inside = np.arange(width - b)[None, :] < (lengths - b)[:, None]
        if used is not None:
            inside &= used[feature]
        row, at = np.nonzero(inside)
        rows.append(row)
        features.append(feature[row, at])
        weights.append(np.full(len(row), DECAY ** (b + 1)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(features), np.concatenate(weights)


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse unit vectors of words (at most ``LONGEST`` letters): word, triple, weight."""
    row, feature, weight = _entries(words)
    key = row * SYMBOLS**3 + feature
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    weight = np.add.reduceat(weight, cut) if len(cut) else weight
    row, feature = key[cut] // SYMBOLS**3, key[cut] % SYMBOLS**3
    norm = np.sqrt(np.bincount(row, weight**2, minlength=len(words)))
    return row, feature, weight / norm[row]


def _least_norm(lengths: np.ndarray) -> np.ndarray:
    """The norm of a word of so many letters if no triple occurs twice in it; never above the real one."""
    total = sum(np.maximum(lengths - b, 0) * DECAY ** (2 * b + 2) for _, b in _PATTERNS)
    return np.sqrt(np.maximum(total, 1e-12))


def landmark_matrix(landmarks: list[str]) -> np.ndarray:
    """One column of triple weights per landmark."""
    matrix = np.zeros((SYMBOLS**3, len(landmarks)), dtype=np.float32)
    row, feature, weight = triples([w[:LONGEST] for w in landmarks])
    matrix[feature, row] = weight
    return matrix


def similarities(words: list[str], matrix: np.ndarray) -> np.ndarray:
    """Kernel of each word with each landmark, or 0 where it is below ``FLOOR``.

    Few triples occur in a landmark, so their sum with the least possible norm
    bounds the kernel from above; only words that may reach the floor are
    compared exactly. Words under three letters have no triples.
    """
    pieces = [(i, p) for i, word in enumerate(words) for p in windows(word) if len(p) >= 3]
    pieces.sort(key=lambda piece: len(piece[1]))
    out = np.zeros((len(words), matrix.shape[1]), dtype=np.float32)
    used = matrix.any(axis=1)
    for start in range(0, len(pieces), PIECES):
        part = pieces[start : start + PIECES]
        row, feature, weight = _entries([p for _, p in part], used)
        order = np.argsort(row, kind="stable")
        sums = _row_sums(row[order], matrix[feature[order]] * weight[order, None].astype(np.float32), len(part))
        least = _least_norm(np.fromiter((len(p) for _, p in part), dtype=np.int64, count=len(part)))
        close = np.flatnonzero(sums.max(axis=1) / least >= FLOOR * 0.999)
        if not len(close):
            continue
        row, feature, weight = triples([part[c][1] for c in close])
        near = _row_sums(row, matrix[feature] * weight[:, None].astype(np.float32), len(close))
        near[near < FLOOR] = 0
        np.maximum.at(out, np.fromiter((part[c][0] for c in close), dtype=np.int64, count=len(close)), near)
    return out


def _row_sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]), dtype=np.float32)
    if len(row):
        cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[cut]] = np.add.reduceat(values, cut, axis=0)
    return out


_nearest: dict[tuple[str, ...], Nearest] = {}


def nearest(landmarks: list[str]) -> Nearest:
    """One for each Python worker and model, until ``forget``."""
    key = tuple(landmarks)
    if key not in _nearest:
        _nearest.clear()
        _nearest[key] = Nearest(landmarks)
    return _nearest[key]


def forget() -> None:
    """Drop what this worker knows of words. A task's closure would only clear its own copy of the table."""
    _nearest.clear()


class Nearest:
    """For whole texts, the similarity of the nearest word to each landmark."""

    def __init__(self, landmarks: list[str], limit: int = CACHE_TOKENS):
        self._matrix = landmark_matrix(landmarks)
        self._limit = limit
        self._known: dict[str, int] = {}
        self._rows = [np.zeros(len(landmarks), dtype=np.float32)]

    def _learn(self, new: list[str]) -> None:
        near = similarities([plain(t) for t in new], self._matrix)
        for token, row, some in zip(new, near, near.any(axis=1)):
            self._known[token] = len(self._rows) if some else 0
            if some:
                self._rows.append(row)

    def describe(self, texts: list[str | None]) -> np.ndarray:
        """Two values per landmark: its nearest word, and how much of the text is near it."""
        m = self._matrix.shape[1]
        out = np.zeros((len(texts), 2 * m), dtype=np.float32)
        for start in range(0, len(texts), 200):
            if len(self._known) > self._limit:
                self._known.clear()
                del self._rows[1:]
            counted = [Counter(tokens(text)) for text in texts[start : start + 200]]
            known = self._known
            new = {t for own in counted for t in own if t not in known}
            if new:
                self._learn(sorted(new))
            for i, own in enumerate(counted):
                hits = [(known[t], n) for t, n in own.items() if known[t]]
                if hits:
                    near = np.stack([self._rows[h] for h, _ in hits])
                    times = np.fromiter((n for _, n in hits), dtype=np.float32, count=len(hits))
                    out[start + i, :m] = near.max(axis=0)
                    share = times @ np.where(near >= CLOSE, near, 0) / (own.total() + SHORT)
                    out[start + i, m:] = np.minimum(share * DENSE, 1)
        return out


def with_inserted(text: str, words: set[str]) -> str:
    """The text with one letter put into each word of the given stems, where the text decides."""
    out = []
    for token in text.split():
        word = plain(token)
        if any(word[:n] in words for n in range(4, len(word) + 1)):
            seed = zlib.crc32(f"{word} {len(text)} {len(out)}".encode())
            at = 1 + seed % (len(word) - 1)
            word = word[:at] + "etxnqzao"[seed // 64 % 8] + word[at:]
            out.append(word)
        else:
            out.append(token)
    return " ".join(out)


@dataclass
class ToxicityModel:
    """Landmarks, the Nyström map folded into one weight per landmark, and a logistic scale."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    base: float

    def score(self, near: np.ndarray) -> np.ndarray:
        margin = near.astype(np.float64) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.base, -30, 30)))


def stems(text: str) -> set[str]:
    """The words of a text and their beginnings of four letters or more."""
    words = {plain(t) for t in set(tokens(text))}
    return {word[:n] for word in words for n in range(4, min(len(word), LONGEST) + 1)}


def choose_landmarks(texts: pd.Series, toxic: np.ndarray) -> list[str]:
    """Words and stems that stand out in toxic texts, best first."""
    seen: dict[str, int] = {}
    for text in texts[toxic > 0]:
        for stem in stems(text):
            seen[stem] = seen.get(stem, 0) + 1
    counts = {stem: [n, 0] for stem, n in seen.items() if n >= 3}
    for text in texts[toxic == 0]:
        for stem in stems(text):
            if stem in counts:
                counts[stem][1] += 1
    clean_n, toxic_n = max(1, int((toxic == 0).sum())), max(1, int(toxic.sum()))
    marks = []
    for word, (n, clean) in counts.items():
        pooled = (n + clean) / (toxic_n + clean_n)
        surprise = (n - toxic_n * pooled) / np.sqrt(toxic_n * pooled * (1 - pooled) + 1e-9)
        p, q = (n + 0.5) / (toxic_n + 1), (clean + 0.5) / (clean_n + 1)
        if p > 3 * q and surprise > 4:
            marks.append((p - q, word))
    marks.sort(key=lambda m: (-m[0], -len(m[1]), m[1]))
    insults: list[str] = []
    for _, word in marks:
        if len(insults) < LANDMARKS and not any(word.startswith(w) or w.startswith(word) for w in insults):
            insults.append(word)
    return insults


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    eye = ridge * np.eye(len(w))
    eye[-1, -1] = 1e-6
    for _ in range(steps):
        inside = y * (x @ w) < 1
        xi, ci = x[inside], cost[inside, None]
        step = np.linalg.solve(eye + xi.T @ (ci * xi), eye @ w + xi.T @ (ci[:, 0] * (xi @ w - y[inside])))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scale: slope and base of the logistic curve through the margins."""
    p, n = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    x, w = np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ ((q * (1 - q))[:, None] * x) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (q - target))
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def fit(texts: pd.Series, toxic: np.ndarray) -> ToxicityModel:
    """Fit on a bounded table of labelled texts; toxic ones count a second time with inserted letters."""
    if not len(texts) or toxic.min() == toxic.max():
        rate = float(toxic.mean()) if len(texts) else 0.0
        odds = np.log((rate * len(texts) + 0.5) / ((1 - rate) * len(texts) + 1.5))
        return ToxicityModel(["nothing"], np.zeros(2), 0.0, 1.0, float(odds))
    insults = choose_landmarks(texts, toxic)
    landmarks = insults or ["nothing"]
    near_of = nearest(landmarks)
    near = near_of.describe(list(texts))
    words = set(insults)
    gapped = [with_inserted(t, words) for t, label in zip(texts, toxic) if label]
    spelt = near_of.describe(gapped)
    matrix = landmark_matrix(landmarks)
    gram = (matrix.T @ matrix).astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    map_ = np.eye(2 * len(landmarks))  # the Nyström map of the nearest words; shares stay as they are
    map_[: len(landmarks), : len(landmarks)] = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    y = np.where(toxic > 0, 1.0, -1.0)
    x = np.r_[near, spelt].astype(np.float64) @ map_
    labels = np.r_[y, np.ones(len(spelt))]
    w = _svm(x, labels, np.full(len(labels), 1.0))
    weights = map_ @ w[:-1]
    slope, base = _logistic(near @ weights + w[-1], y)
    return ToxicityModel(landmarks, weights, float(w[-1]), slope, base)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN
) -> DataFrame:
    """(text, toxic) of at most so many labelled rows of either kind: those of lowest id hash."""
    usable = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    chosen = [
        usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for label, n in ((1, max_toxic), (0, max_clean))
    ]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most max_toxic + max_clean rows
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(ids, "doc_id").select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Labels other than 0 and 1, null texts and ids without a document do not
    count. The fit itself uses at most ``MAX_TOXIC`` + ``MAX_CLEAN`` texts; a
    text repeated under one id counts once.
    """
    table = labelled_sample(docs, labels).dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    return fit(table["text"], table["toxic"].to_numpy(dtype=np.int64))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (score >= threshold) of each whole text.

    Null and empty texts get the score of a text without any similar word. All
    other columns stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    names = [n for n in docs.columns if n not in ("score", "predicted")]
    docs = docs.select(*[F.col(f"`{n}`") for n in names])
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_of = nearest(shared.value.landmarks)
        for batch in batches:
            value = shared.value.score(near_of.describe(batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(value), pa.array((value >= threshold).astype(np.int32))],
                [*names, "score", "predicted"],
            )

    out = T.StructType([schema[n] for n in names]).add("score", "double").add("predicted", "integer")
    return docs.mapInArrow(released(run, forget), out)
