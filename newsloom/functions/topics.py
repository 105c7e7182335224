"""Topic validation and clean-up, as columns over a table of topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_TOPIC_LENGTH = 100
SPECIAL_CHARACTERS = "!@#$%^&*()-_=+{}[]|:;\"'<>,.?/\\"
TOPIC_STOP_WORDS = (
    "the", "is", "in", "and", "to", "a", "of", "for", "on", "with", "as", "by", "this", "that",
)


def clean_topic(topic: Column) -> Column:
    """Lower case, special characters to spaces, runs of spaces to one."""
    spaced = F.translate(F.lower(topic), SPECIAL_CHARACTERS, " " * len(SPECIAL_CHARACTERS))
    return F.trim(F.regexp_replace(spaced, " +", " "))


def drop_topic_stop_words(topic: Column) -> Column:
    """Keeps order and repeats of the words that stay."""
    kept = F.filter(
        F.split(topic, " "), lambda w: (F.length(w) > 0) & ~w.isin(*TOPIC_STOP_WORDS)
    )
    return F.array_join(kept, " ")


def normalize_topic(topic: Column) -> Column:
    return drop_topic_stop_words(clean_topic(topic))


def reject_reason(topic: Column) -> Column:
    """Why a topic is refused, or null. The first failing check names the reason."""
    return (
        F.when(topic.isNull() | (topic == ""), "empty")
        .when(F.length(topic) > MAX_TOPIC_LENGTH, "too_long")
        .when(~topic.rlike(r"\A[\x00-\x7F]*\z"), "non_ascii")
        .when(~topic.rlike(r"\A[\x20-\x7E]*\z"), "non_printable")
        .when(topic.rlike(r"\A[0-9]"), "starts_with_digit")
        .when(topic.startswith(" "), "starts_with_space")
        .when(clean_topic(topic) == "", "empty_after_cleanup")
        .when(normalize_topic(topic) == "", "only_stop_words")
    )


def topic_slug(topic: str | None) -> str:
    """File name stem of a digest."""
    return topic.replace(" ", "_") if topic and topic.strip() else "batch_upload"
