"""Default sentiment: sum of word polarities through a logistic curve."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.once import with_once
from newsloom.functions.summary import NO_INPUT
from newsloom.functions.text import is_blank, tokens

# A small general-purpose English lexicon; pass your own for real use.
LEXICON: Mapping[str, int] = {
    **dict.fromkeys(
        "good great best better win wins won success growth gain gains strong hope happy "
        "safe peace award benefit improve improved improves record progress".split(),
        1,
    ),
    **dict.fromkeys(
        "bad worst worse lose loses lost loss fail fails failure crisis weak fear war death "
        "dead crash attack threat decline fraud danger worthless".split(),
        -1,
    ),
}
MAX_LEXICON = 100_000  # the lexicon travels inside the plan


def polarity(token_array: Column, lexicon: Mapping[str, int] = LEXICON) -> Column:
    """Sum of the polarities of all tokens; words of one polarity form one hash set."""
    if len(lexicon) > MAX_LEXICON:
        raise ValueError(f"lexicon has {len(lexicon)} words, at most {MAX_LEXICON} are allowed")
    total = F.lit(0)
    for value in sorted(set(lexicon.values())):
        group = [word for word, p in lexicon.items() if p == value]
        total = total + F.lit(value) * F.size(F.filter(token_array, lambda w: w.isin(group)))
    return total


def with_sentiment(
    df: DataFrame,
    text: str = "summary",
    label: str = "sentiment",
    score: str = "score",
    lexicon: Mapping[str, int] = LEXICON,
) -> DataFrame:
    """Add a label and a score in [0.5, 1]; blank text gives a fixed pair."""
    x = F.col("_polarity")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))
    blank = is_blank(F.col(text))
    named = F.when(x > 0, "POSITIVE").when(x < 0, "NEGATIVE").otherwise("NEUTRAL")
    return (
        with_once(
            df.withColumn("_tokens", tokens(F.col(text))),
            _polarity=polarity(F.col("_tokens"), lexicon),
        )
        .withColumn(label, F.when(blank, NO_INPUT).otherwise(named))
        .withColumn(score, F.when(blank, 0.0).otherwise(F.round(F.greatest(p, 1 - p), 9)))
        .drop("_tokens", "_polarity")
    )
