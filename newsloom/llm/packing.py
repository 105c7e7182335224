"""Best-fit packing of tokenised documents into sequences of a fixed length.

One pass over the texts tokenises, cuts and ranks the pieces; all that follows
works on a few numbers per piece. The plan is made from the histogram of piece
lengths, so its size depends on the capacity and not on the number of documents.
Each piece then takes the planned slot of its rank within its length.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.workers import released
from newsloom.session import materialize

CAPACITY = 1024
END_ID = 2
# The added token of byte_bpe_50k.json, which is cut out of a text before anything else, and its id.
ADDED, ADDED_ID = "<|endoftext|>", 50256
#: The ranks of the vocabulary byte_bpe_50k.json, in the form that the faster encoder reads.
RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Words whose ids a Python worker remembers; when full, the older half goes.
CACHE_WORDS = 300_000

_DOUBLE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
_RARE_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of a whole text, as little-endian unsigned 32-bit bytes.

    The pre-tokenizer always cuts before a single space that has no other white
    space beside it. A text is split at those spaces and the ids of each part
    are remembered, since words repeat. The added token has its own id wherever it
    stands, and the texts between are tokenised apart.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self._limit = limit
        self._known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.asarray(self._encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def _learn(self, word: str) -> bytes:
        ids = self._ids(" " + word)
        if len(word) <= 48:
            if len(self._known) >= self._limit:
                for old in list(self._known)[: self._limit // 2]:
                    del self._known[old]
            self._known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if ADDED in text:
            between = np.asarray([ADDED_ID], dtype="<u4").tobytes()
            return between.join([self._plain(part) for part in text.split(ADDED)])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if any(pair in text for pair in _DOUBLE) or _RARE_SPACE.search(text):
            first, *words = _SAFE_CUT.split(text)
        else:
            first, *words = text.split(" ")
        known, learn = self._known.get, self._learn
        return self._ids(first) + b"".join([known(word) or learn(word) for word in words])


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS_FILE)


def cut(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what does not fill a sequence."""
    first = length % capacity or capacity
    start = 0
    while start < length:
        yield start, first
        start, first = start + first, capacity


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, task_rank long"


def tokenised_pieces(
    docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(ranks_path).encode, TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    row = (
                        doc_id, piece, start, length,
                        zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length],
                    )
                    seen[length] += 1
                    for column, value in zip(columns, row):
                        column.append(value)
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), PIECES)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Best-fit decreasing over counts: where the pieces of each length go.

    A run says: from ``first_rank`` on, the pieces of ``length`` go to the
    sequences from ``first_sequence`` on, ``per_sequence`` to each, and stand
    there from ``first_offset`` on. Sequences that look alike are filled as one,
    exactly as if the pieces were placed one by one, longest first, each in the
    fullest sequence that still takes it. A length splits at most two runs, so
    the plan has at most about 3 x ``capacity`` squared rows whatever the counts.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: (first sequence, number)
    frees: list[int] = []  # sorted keys of room
    made = 0

    def put(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                room[free] = []
                insort(frees, free)
            room[free].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(frees, length)
            if at < len(frees):
                free = frees[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free]
                    frees.pop(at)
            else:
                free, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = free // length
            full = min(n, left // each)
            rest = min(left - full * each, each - 1) if full < n else 0
            if full:
                runs.append((length, rank, first, each, capacity - free))
                put(free - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if rest:
                runs.append((length, rank, first + full, rest, capacity - free))
                put(free - rest * length, first + full, 1)
                rank, left = rank + rest, left - rest
            used = full + bool(rest)
            put(free, first + used, n - used)
    names = ("length", "first_rank", "first_sequence", "per_sequence", "first_offset")
    table = np.asarray(runs, dtype=np.int64).reshape(-1, 5)
    return dict(zip(names, table.T))


def pack(
    docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one
    row per piece. A null or empty text is the end id alone; repeated rows and
    repeated ids are packed as often as they occur; an empty table gives no rows;
    other columns are ignored. A text is tokenised whole in one task.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenised_pieces(docs, ranks_path or default_ranks(), capacity, end_id), "pack-pieces")
    by_task = materialize(
        pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts"
    )
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_slots(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("task_rank")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        shift = 1 << 50  # above any rank
        order = np.lexsort((runs["first_rank"], runs["length"]))
        runs = {k: v[order] for k, v in runs.items()}
        keys = runs["length"] * shift + runs["first_rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            i = rank - runs["first_rank"][at]
            each = runs["per_sequence"][at]
            sequence = runs["first_sequence"][at] + i // each
            offset = runs["first_offset"][at] + (i % each) * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
