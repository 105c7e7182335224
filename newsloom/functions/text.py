"""Column expressions over text. All are narrow: one row in, one row out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.stopwords import STOP_WORDS

# Unicode white space plus the four ASCII separators U+001C to U+001F: as a
# java.util.regex class, and as a list of characters.
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
TOKEN = r"[\p{L}\p{N}_]{2,}"

# Words of this many characters or more are dropped, and chunks
# hold this many words.
LONG_WORD = 100
CHUNK_WORDS = 512


def strip(text: Column) -> Column:
    """Trim white space of any kind, not only the space character."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.length(strip(text)) == 0)


def words(text: Column) -> Column:
    """Split on runs of white space, without empty pieces."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: F.length(w) > 0)


def clean_text(text: Column) -> Column:
    """Collapse white space and drop overlong words."""
    kept = F.filter(words(text), lambda w: F.length(w) < LONG_WORD)
    return F.array_join(kept, " ")


def chunks_of(word_array: Column, size: int = CHUNK_WORDS) -> Column:
    """Runs of ``size`` words, each joined by a space; no words, no chunks."""
    n = F.size(word_array)
    numbers = F.sequence(F.lit(0), (F.ceil(n / size) - 1).cast("int"))
    runs = F.transform(
        numbers, lambda i: F.array_join(F.slice(word_array, i * size + 1, F.lit(size)), " ")
    )
    return F.when(n > 0, runs).otherwise(F.array().cast("array<string>"))


def capitalize(text: Column) -> Column:
    """First character upper case, all others lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def content_tokens(text: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Tokens that are not stop words. The list becomes a hash set in the plan."""
    stop = list(stop_words)
    if not stop:
        return tokens(text)
    return F.filter(tokens(text), lambda w: ~w.isin(stop))


def with_bigrams(token_array: Column) -> Column:
    """The tokens followed by each pair of neighbours."""
    pairs = F.greatest(F.size(token_array) - 1, F.lit(0))
    left = F.slice(token_array, F.lit(1), pairs)
    right = F.slice(token_array, F.lit(2), pairs)
    return F.concat(token_array, F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b)))
