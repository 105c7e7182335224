"""Default extractive summary: a word-frequency method (Luhn 1958).

Sentences are scored by the mean frequency, within the article, of their
content words; the best three are given in text order. Sentences and words are
arrays inside the article's own row, so nothing is shuffled; a batch of articles
is ranked at a time. Frequencies come from sorting, never from comparing each word
with each other word, so long articles stay cheap.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.stopwords import STOP_WORDS
from newsloom.functions.text import content_tokens, is_blank, strip

NO_INPUT = "No input provided."  # fixed value
SENTENCE = r"[^.!?\n]+[.!?]*"
SENTENCES_KEPT = 3


def sentences(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), strip)
    return F.filter(found, lambda s: F.length(s) > 0)


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)


def best_sentences(words: pa.Array, keep: int) -> pa.Array:
    """For each text, given as the content words of its sentences, the places of the best ``keep``, in order.

    Words are numbered once for all texts; a sort of (text, word) counts them. Of equal
    sentences the first is better; sentences without content words come last.
    """
    per_text = _lengths(words)
    inner = words.flatten()
    per_sentence = _lengths(inner)
    text = np.repeat(np.arange(len(words)), per_text)
    place = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    sentence = np.repeat(np.arange(len(text)), per_sentence)
    coded = inner.flatten().dictionary_encode()
    key = text[sentence] * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    _, number, times = np.unique(key, return_inverse=True, return_counts=True)
    total = np.bincount(sentence, times[number], len(text))
    rank = -total / np.maximum(per_sentence, 1)
    order = np.lexsort((place, rank, text))  # the texts stay in order, so a text's sentences keep their range
    kept = np.sort(order[place < keep])
    offsets = np.r_[0, np.cumsum(np.minimum(per_text, keep))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place[kept], pa.int32()))


def with_summary(
    df: DataFrame,
    content: str = "content",
    out: str = "summary",
    stop_words: Iterable[str] = STOP_WORDS,
    keep: int = SENTENCES_KEPT,
) -> DataFrame:
    """Add the summary of ``content``; blank content gives a fixed message."""
    stop = tuple(stop_words)
    c = F.col

    @F.arrow_udf("array<int>")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            yield best_sentences(words, keep)

    kept = F.transform("_kept", lambda i: F.get(c("_sentences"), i))
    return (
        df.withColumn("_sentences", sentences(c(content)))
        .withColumn("_kept", best(F.transform("_sentences", lambda s: content_tokens(s, stop))))
        .withColumn(out, F.when(is_blank(c(content)), NO_INPUT).otherwise(F.array_join(kept, " ")))
        .drop("_sentences", "_kept")
    )
