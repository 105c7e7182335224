"""Default text vectors: a signed count sketch with TF-IDF weights, of unit length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import content_tokens

DIMENSIONS = 512


def bucket(word: str, dimensions: int) -> tuple[int, float]:
    """Where a word counts and with which sign: the first seven and the eighth hex digit of its MD5."""
    digest = hashlib.md5(word.encode()).hexdigest()
    return int(digest[:7], 16) % dimensions, 1.0 if digest[7] < "8" else -1.0


def sketches(tokens: pa.Array, dimensions: int) -> np.ndarray:
    """One row of signed counts per list of words; each word of a batch is hashed once."""
    words = tokens.flatten().dictionary_encode()
    coded = [bucket(w, dimensions) for w in words.dictionary.to_pylist()]
    place, sign = (np.asarray(c) for c in zip(*coded)) if coded else (np.zeros(0, int), np.zeros(0))
    lengths = np.diff(tokens.offsets.to_numpy()) if len(tokens) else np.zeros(0, int)
    rows = np.repeat(np.arange(len(tokens)), lengths)
    codes = words.indices.to_numpy()
    flat = np.bincount(rows * dimensions + place[codes], sign[codes], len(tokens) * dimensions)
    return flat.reshape(len(tokens), dimensions)


def document_counts(tokens: DataFrame, dimensions: int) -> tuple[int, np.ndarray]:
    """Rows, and for each bucket the rows whose sketch is not 0 there; ``tokens`` has that one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, np.zeros(dimensions, np.int64)
        for batch in batches:
            n += batch.num_rows
            found += (sketches(batch.column(0), dimensions) != 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dimensions), pa.int32()), pa.array(np.r_[n, found])], ["b", "n"])

    rows = tokens.mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    counts = {r["b"]: r["n"] for r in rows}
    return counts.get(-1, 0), np.asarray([counts.get(b, 0) for b in range(dimensions)])


def embed(
    df: DataFrame, content: str = "content", out: str = "features", dimensions: int = DIMENSIONS
) -> DataFrame:
    """Add a vector column. A text without content words gets the zero vector.

    Component b is the sum of the signs of the words of bucket b, times
    ln((rows + 1) / (rows with that sum not 0 + 1)), over the length of the whole.
    """
    words = content_tokens(F.coalesce(F.col(content), F.lit("")))
    n, found = document_counts(df.select(words.alias("tokens")), dimensions)
    weight = np.log((n + 1) / (found + 1))

    @F.arrow_udf("array<double>")
    def unit(tokens: pa.Array) -> pa.Array:
        rows = sketches(tokens, dimensions) * weight
        length = np.sqrt((rows * rows).sum(axis=1))[:, None]
        flat = np.where(length > 0, rows / np.where(length > 0, length, 1.0), 0.0).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1) * dimensions, pa.int32()), pa.array(flat))

    return df.withColumn(out, array_to_vector(unit(words)))
