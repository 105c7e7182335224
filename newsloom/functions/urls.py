"""URL predicates. Every one gives true or false, never null."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed values.
PAYWALL_INDICATORS = ("paywall", "subscription", "premium")
BLOCKED_SITES = ("example.com", "blockedsite.com")

# Fixed pattern: scheme; then a domain, localhost, an IPv4 or an IPv6 address;
# then an optional port and an optional path. (?d) lets $ see only \n as a line
# end.
URL_SCHEME = r"^(?:http|ftp)s?://"
URL_HOST = (
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+(?:[A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)|"
    r"localhost|"
    r"\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}|"
    r"\[?[A-F0-9]*:[A-F0-9:]+\]?)"
)
URL_TAIL = r"(?::\p{Nd}+)?(?:/?|[/?][^\s\p{Z}\x0b\x1c-\x1f\x{85}]+)$"
URL_PATTERN = URL_SCHEME + URL_HOST + URL_TAIL


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    return _sure(reduce(lambda a, b: a | b, (text.contains(n) for n in needles), F.lit(False)))


def is_valid_url(url: Column) -> Column:
    return _sure(url.rlike("(?di)" + URL_PATTERN))


def is_paywalled(url: Column, indicators: Iterable[str] = PAYWALL_INDICATORS) -> Column:
    return contains_any(url, indicators)


def is_blocked_site(url: Column, sites: Iterable[str] = BLOCKED_SITES) -> Column:
    return contains_any(url, sites)


def is_acceptable_url(url: Column) -> Column:
    """Non-empty, well formed, not paywalled. Broken links need a status table,
    see ``plans.harvest.reachable``."""
    return _sure(url != "") & is_valid_url(url) & ~is_paywalled(url)


def is_empty_content(text: Column) -> Column:
    """No article or no text; white space counts as text."""
    return text.isNull() | (text == "")


def is_paywalled_content(url: Column, text: Column) -> Column:
    return ~is_empty_content(text) & is_paywalled(url)


def is_blocked_content(url: Column, text: Column) -> Column:
    return ~is_empty_content(text) & is_blocked_site(url)
