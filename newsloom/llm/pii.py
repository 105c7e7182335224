"""Personal data: exact base patterns, and a semi-Markov CRF for what they miss.

The CRF scores whole spans of up to ``MAX_ATOMS`` atoms (runs of letters and
digits, single other characters). Its dynamic program chooses boundaries and
types together. It is trained on sentences made from written templates.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.workers import released

#: Kinds of the base patterns, in their fixed order, and the one that only the CRF knows.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
MAX_ATOMS = 13
#: Characters on either side of a seed that belong to its region.
REACH = 28

# The base patterns. A run of digits is only entered at its start,
# where every match inside it would begin.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SPELT = re.compile(
    r"\b[aA][tT]\b\s?[\])]?\s?(?:[\w.-]+(?:\s?[\[(]?\s?\b[dD][oO][tT]\b\s?[\])]?\s?[\w-]+)+|[\w-]+(?:\.[\w-]+)*\.[^\W\d_][\w-]*)"
)
_SEED = re.compile(r"[0-9](?:[0-9A-Fa-f \x20().:_-]*[0-9])?|@")
_ATOM = re.compile(r"[^\W_]+|.", re.S)
_HEX = re.compile(r"[0-9a-fA-F]+\Z")

Span = tuple[int, int, int]  # start, index of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, 0, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """All spans of the base patterns in a whole text, by start and kind."""
    found = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = "".join(_DIGITS.findall(m.group()))
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold personal data: around '@', seven digits or more, and 'at' before a host, dotted or spelt."""
    spots = []
    if "@" in text or _DIGIT.search(text):
        spots += [
            m.span() for m in _SEED.finditer(text)
            if m.group() == "@" or sum(map(str.isdigit, m.group())) >= 7
        ]
    spots += [m.span() for m in _SPELT.finditer(text)]
    out: list[tuple[int, int]] = []
    for start, end in sorted(spots):
        start, end = max(0, start - REACH), min(len(text), end + REACH)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def atoms(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _ATOM.finditer(text, start, end)]


_CUES = (
    ("mail", ("mail", "email", "contact", "write")), ("call", ("call", "phone", "tel", "fax", "mobile")),
    ("card", ("card", "visa", "pay", "iban", "account")), ("net", ("ip", "host", "server", "address")),
    ("key", ("token", "key", "secret", "password", "apikey", "auth", "pass")),
)
_NAMES = (
    "bias", "at", "spelt at", "dots in address", "word ends", "four numbers", "numbers fit a byte", "luhn",
    "card length", "phone length", "few digits", "many digits", "plus", "brackets", "groups", "plain digits",
    "hex 32", "hex short", "mixed", "space edge", "mark edge", "joined left", "joined right", "letters in digits",
    "several spaces", "one atom", "long", *[f"cue {name}" for name, _ in _CUES],
)
_AT = {name: i for i, name in enumerate(_NAMES)}


def span_features(text: str, start: int, end: int, n_atoms: int, cue: int) -> list[int]:
    """Indices of the features that hold for the whole span."""
    s = text[start:end]
    digits = "".join(_DIGITS.findall(s))
    letters = sum(map(str.isalpha, s))
    n, on = len(digits), [0]
    low = s.lower()
    if "@" in s:
        on.append(_AT["at"])
    if " at " in low or "(at)" in low or "[at]" in low:
        on.append(_AT["spelt at"])
    if "@" in s or " at " in low or "at)" in low or "at]" in low:
        tail = low.replace(" dot ", ".").replace("(dot)", ".").replace("[dot]", ".").rpartition(".")[2].strip()
        if tail.isalpha() and 2 <= len(tail) <= 6 and tail != low:
            on.append(_AT["dots in address"])
    if s[:1].isalnum() and s[-1:].isalnum():
        on.append(_AT["word ends"])
    numbers = s.split(".")
    if len(numbers) == 4 and all(p.isdigit() for p in numbers):
        on.append(_AT["four numbers"])
        if all(len(p) <= 3 and int(p) <= 255 for p in numbers):
            on.append(_AT["numbers fit a byte"])
    if 12 <= n <= 19:
        on.append(_AT["card length"])
        if luhn(digits):
            on.append(_AT["luhn"])
    if 7 <= n <= 15:
        on.append(_AT["phone length"])
    on.append(_AT["few digits"] if n < 7 else _AT["many digits"])
    if s[0] == "+" or s.startswith("00"):
        on.append(_AT["plus"])
    if "(" in s and ")" in s:
        on.append(_AT["brackets"])
    if n and not letters:
        on.append(_AT["groups"] if n < len(s) else _AT["plain digits"])
    if n and letters:
        if _HEX.match(s):
            on.append(_AT["hex 32"] if len(s) >= 32 else _AT["hex short"])
        else:
            on.append(_AT["mixed"])
        if "@" not in s:
            on.append(_AT["letters in digits"])
    if s[0].isspace() or s[-1].isspace():
        on.append(_AT["space edge"])
    elif not (s[0].isalnum() or s[0] in "+(") or not s[-1].isalnum():
        on.append(_AT["mark edge"])
    if start and (text[start - 1].isalnum() or text[start - 1] in "._-@+"):
        on.append(_AT["joined left"])
    if end < len(text) and (text[end].isalnum() or text[end] in "@_-" or (text[end] == "." and text[end + 1 : end + 2].isalnum())):
        on.append(_AT["joined right"])
    if s.count(" ") > 2 and not n:
        on.append(_AT["several spaces"])
    if n_atoms == 1:
        on.append(_AT["one atom"])
    if len(s) > 20:
        on.append(_AT["long"])
    if cue >= 0:
        on.append(len(_NAMES) - len(_CUES) + cue)
    return on


def _cue(text: str, start: int) -> int:
    """Which kind of cue word stands shortly before the span."""
    before = re.findall(r"[a-z]+", text[max(0, start - 16) : start].lower())
    for word in before[-2:]:
        for i, (_, words) in enumerate(_CUES):
            if word in words:
                return i
    return -1


@dataclass
class Lattice:
    """All candidate spans of a region: end atom, length in atoms, features."""

    places: list[tuple[int, int]]
    ends: list[list[int]]  # per end position: indices of spans that end there
    spans: list[tuple[int, int]]  # first atom, atom after the last
    features: np.ndarray


def lattice(text: str, start: int, end: int) -> Lattice:
    places = atoms(text, start, end)
    ends: list[list[int]] = [[] for _ in range(len(places) + 1)]
    spans, rows = [], []
    for i, (a, _) in enumerate(places):
        if text[a].isspace():
            continue
        cue = _cue(text, a)
        for j in range(i + 1, min(len(places), i + MAX_ATOMS) + 1):
            b = places[j - 1][1]
            if text[b - 1].isspace():
                continue
            ends[j].append(len(spans))
            spans.append((i, j))
            rows.append(span_features(text, a, b, j - i, cue))
    features = np.zeros((len(rows), len(_NAMES)))
    for r, on in enumerate(rows):
        features[r, on] = 1.0
    return Lattice(places, ends, spans, features)


class SemiCRF:
    """Span scores are linear in the features; an atom outside all spans scores nothing."""

    def __init__(self) -> None:
        self.weights = np.zeros((len(_NAMES), len(KINDS)))

    def marginals(self, x: Lattice) -> np.ndarray:
        """Probability of every (span, kind), by the forward and backward sums."""
        score = x.features @ self.weights
        total = np.logaddexp.reduce(score, axis=1) if len(score) else np.zeros(0)
        n = len(x.places)
        forward, backward = np.zeros(n + 1), np.zeros(n + 1)
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for at, (i, _) in enumerate(x.spans):
            starts[i].append(at)
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *[forward[x.spans[s][0]] + total[s] for s in x.ends[j]]])
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp.reduce([backward[i + 1], *[backward[x.spans[s][1]] + total[s] for s in starts[i]]])
        outside = np.array([forward[i] + backward[j] for i, j in x.spans]) - forward[n]
        return np.exp(score + outside[:, None])

    def best(self, x: Lattice) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best joint choice of spans."""
        if not x.spans:
            return []
        score = x.features @ self.weights
        kind, top = score.argmax(axis=1), score.max(axis=1).tolist()
        n = len(x.places)
        value, back = [0.0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for s in x.ends[j]:
                if (v := value[x.spans[s][0]] + top[s]) > value[j]:
                    value[j], back[j] = v, s
        out, j = [], n
        while j:
            if back[j] < 0:
                j -= 1
            else:
                i, _ = x.spans[back[j]]
                out.append((x.places[i][0], int(kind[back[j]]), x.places[j - 1][1]))
                j = i
        return out[::-1]

    def fit(self, sentences: list[tuple[str, list[Span]]], rounds: int = 12, rate: float = 0.3) -> SemiCRF:
        """Maximum conditional likelihood with a small ridge, by adaptive gradient steps."""
        data = []
        for text, spans in sentences:
            x = lattice(text, 0, len(text))
            where = {(x.places[i][0], x.places[j - 1][1]): s for s, (i, j) in enumerate(x.spans)}
            gold = np.zeros((len(x.spans), len(KINDS)))
            for start, kind, end in spans:
                if (start, end) in where:
                    gold[where[start, end], kind] = 1.0
            data.append((x, gold))
        seen = np.full_like(self.weights, 1e-6)
        for _ in range(rounds):
            for x, gold in data:
                slope = x.features.T @ (gold - self.marginals(x)) - 0.002 * self.weights
                seen += slope**2
                self.weights += rate * slope / np.sqrt(seen)
        return self


_WORDS = (
    "the of and to in is that for it as was with be by on not he this are or his from at which but have an had "
    "they you were there one all we can her has their been if more when will would who so no contact please "
    "version page item order total year number mail call card server der die und la el les des une que para"
).split()


def made_sentences(n: int = 240, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """The labelled training table: sentences from templates, with the spans that were put in."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: rng.choice(_WORDS)

    def card() -> str:
        body = "4" + digits(14)
        number = next(body + d for d in "0123456789" if luhn(body + d))
        sep = rng.choice(["", " ", "-", ".", "  "])
        return sep.join(number[i : i + 4] for i in range(0, 16, 4)) if sep else number

    def email() -> str:
        user, host, end = word() + rng.choice([".", "_", ""]) + word(), word() + word(), rng.choice(["com", "org", "net", "de"])
        return rng.choice([f"{user}@{host}.{end}", f"{user} at {host} dot {end}", f"{user}(at){host}.{end}", f"{user}[at]{host}[dot]{end}"])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {a} {b}{c}", f"0049 {a} {b}{c}", f"{a}.{b}.{c}"])

    def secret() -> str:
        k = rng.choice([32, 40, 64])
        return "a" + "".join(rng.choice("0123456789abcdef") for _ in range(k - 2)) + "7"

    def wrong() -> str:
        return next(d for d in iter(lambda: digits(16), "") if not luhn(d))

    ip = lambda: ".".join(str(rng.randrange(256)) for _ in range(4))
    made = (email, ip, card, phone, secret)
    cues = (("mail ", "", "write to "), ("server ", "", "host "), ("card ", "", "account "), ("call ", "tel: ", ""), ('token = "', "key: ", "secret "))
    out = []
    for i in range(n):
        before, after = " ".join(word() for _ in range(rng.randrange(4))), " ".join(word() for _ in range(rng.randrange(3)))
        if i % 3 == 2:  # nothing personal: dates, versions, prices, counts, long numbers that fail the checks
            body = rng.choice([
                f"2024-0{digits(1)}-1{digits(1)}", f"version {digits(1)}.{digits(1)}.{digits(2)}", f"{digits(7)} {word()}",
                f"{digits(3)},{digits(3)}", f"{word()} at {word()}", f"no. {digits(11)}", f"{digits(5)} {digits(5)} {digits(2)}",
                f"{word()} @ {word()}", f"{word()} at {word()}. {word().title()}", wrong(), wrong(), f"20{digits(2)} {digits(4)} {digits(2)}", f"{digits(4)}:{digits(2)}:{digits(2)}",
            ])
            out.append((" ".join(filter(None, (before, body, after))) + ".", []))
            continue
        kind = i % 15 % 5
        value, cue = made[kind](), rng.choice(cues[kind])
        text = f"{before} {cue}".lstrip() + value
        start = len(text) - len(value)
        text += ('"' if cue.endswith('"') else "") + rng.choice([" ", ", ", ". "]) + after
        out.append((text, [(start, kind, start + len(value))]))
    return out


@lru_cache(maxsize=1)
def trained() -> SemiCRF:
    return SemiCRF().fit(made_sentences())


def all_spans(text: str, model: SemiCRF) -> tuple[list[Span], list[Span]]:
    """The base spans, and these with the spans of the CRF that touch none of them."""
    base = base_spans(text)
    added = []
    for start, end in regions(text):
        own = [s for s in base if s[0] < end and s[2] > start]
        if own and not _left(text, start, end, own):
            continue
        for span in model.best(lattice(text, start, end)):
            if not any(s[0] < span[2] and s[2] > span[0] for s in own):
                added.append(span)
    return base, sorted(base + added)


def _left(text: str, start: int, end: int, own: list[Span]) -> bool:
    """Whether a region has a seed outside its base spans."""
    held = text[start:end]
    for a, _, b in own:
        a, b = max(a, start) - start, min(b, end) - start
        held = held[:a] + " " * (b - a) + held[b:]
    return "@" in held or sum(map(len, _DIGITS.findall(held))) >= 7 or bool(_SPELT.search(held))


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: SemiCRF | None = None) -> DataFrame:
    """Spans of personal data in every whole text of ``docs`` (doc_id, text).

    Returns ``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256``
    (of the listed base spans) and ``spans`` (all, listed as kind:start:end by
    start and then kind). Null and empty texts have no spans. Rows are kept one to
    one, repeated ones too; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            hashes, listed = [], []
            for text in batch.column(1):
                base, spans = all_spans(text.as_py() or "", shared.value)
                for k, own in enumerate(counts):
                    own.append(sum(s[1] == k for s in base))
                hashes.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                listed.append(_listed(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(listed, pa.string())],
                ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def masked(text: str, model: SemiCRF) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first one."""
    out, end, kind = [], 0, -1
    for a, k, b in all_spans(text, model)[1]:
        if kind >= 0 and a < end:
            end = max(end, b)
            continue
        out.append(text[end:a])
        out.append(f"[{KINDS[k]}]")
        end, kind = b, k
    out.append(text[end:])
    return "".join(out)


def mask(docs: DataFrame, model: SemiCRF | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind; ``n_chars``, if there, follows.

    Null texts stay null; all rows and other columns stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else masked(t, shared.value) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                n = [None if t is None else len(t) for t in texts]
                columns[names.index("n_chars")] = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([T.StructField("n_chars", T.LongType()) if f.name == "n_chars" else f for f in docs.schema])
    return docs.mapInArrow(released(run), schema)
