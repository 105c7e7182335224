"""Title and body text of an HTML page, as column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import strip

MIN_LENGTH = 300  # fixed value: shorter bodies count as failed extractions
UNTITLED = "Untitled"

# Patterns stay within what java.util.regex and RE2 share.
INVISIBLE = (
    r"(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>"
)
PARAGRAPH_START = r"(?i)<p(?:\s[^>]*)?>"
PARAGRAPH_END = r"(?is)</(?:p|article|body)[\s>].*"
TAG = r"<[^>]*>"
TITLE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title"
# From the first article element to the end of the last: nested and sibling ones are kept whole.
ARTICLE = r"(?is)<article(?:\s[^>]*)?>(.*)</article"

# Elements around the content, and tags that begin or end a block of text.
AROUND = r"(?i)</?(?:nav|aside|footer|header|form)(?:[\s/][^>]*)?>"
BLOCK = (
    r"(?i)</?(?:address|article|blockquote|body|br|dd|div|dl|dt|figcaption|figure|h[1-6]|head|hr|html|li|main|"
    r"ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[\s/][^>]*)?>"
)
LINK = r"(?is)<a(?:\s[^>]*)?>(.*?)</a\s*>"
BLOCK_LENGTH = 40  # characters of a block of running text at least
LINKED = 3  # one character in so many may be linked

ALL = 1 << 30  # a slice to the end
REFERENCE = r"^#?[A-Za-z0-9]+;"

# The named references of HTML 4 and XML, the frequent ones first.
NAMED = {
    "amp": "&", "nbsp": "\u00a0", "quot": '"', "lt": "<", "gt": ">", "apos": "'",
    **{name: chr(code) for name, code in sorted(name2codepoint.items())},
}


def _numbered(name: Column) -> Column:
    """The character of ``#233`` or ``#xE9``, null if there is none."""
    is_hex = F.lower(F.substring(name, 2, 1)) == "x"
    code = F.when(is_hex, F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(
        F.substr(name, F.lit(2))
    ).try_cast("int")
    in_range = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(in_range, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Replace character references, each once: ``&amp;lt;`` becomes ``&lt;``.

    References end with a semicolon; unknown ones stay as they are.
    """
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def parted(piece):
        reference = F.regexp_extract(piece, REFERENCE, 0)
        return F.struct(piece.alias("piece"), F.rtrim(reference, F.lit(";")).alias("name"))

    def decoded(part, number):
        piece, name = part["piece"], part["name"]
        character = F.when(F.substring(name, 1, 1) == "#", _numbered(name)).otherwise(named[name])
        rest = F.substr(piece, F.length(name) + 2)
        kept = F.concat(F.lit("&"), piece)
        return (
            F.when(number == 0, piece)
            .when(name == "", kept)
            .otherwise(F.coalesce(F.concat(character, rest), kept))
        )

    parts = F.transform(F.split(text, "&"), parted)
    return F.array_join(F.transform(parts, decoded), "")


def visible(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(html, INVISIBLE, "")


def raw_title(visible_html: Column) -> Column:
    return F.regexp_extract(visible_html, TITLE, 1)


def clean_title(raw: Column) -> Column:
    """Trimmed title; a page without one is "Untitled"."""
    return F.when(raw == "", UNTITLED).otherwise(strip(decode_entities(raw)))


def paragraph_text(visible_html: Column) -> Column:
    """Texts of all paragraphs, joined by a space; character references stay.

    A new paragraph ends the one before, so no text is counted twice.
    """
    pieces = F.split(visible_html, PARAGRAPH_START)
    bodies = F.slice(pieces, 2, ALL)
    texts = F.transform(
        bodies, lambda p: F.regexp_replace(F.regexp_replace(p, PARAGRAPH_END, ""), TAG, "")
    )
    return F.array_join(texts, " ")


def clean_body(paragraphs: Column) -> Column:
    return strip(decode_entities(paragraphs))


def article_element(visible_html: Column) -> Column:
    """Inner HTML from the first article element to the end of the last, or ''."""
    return F.regexp_extract(visible_html, ARTICLE, 1)


def outside(visible_html: Column) -> Column:
    """The parts of a page that are in no navigation, header, footer, aside or form.

    A fold over these tags keeps the depth: a part counts at depth 0 only, however the
    elements nest; an end tag without a start does nothing.
    """
    tags, parts = F.regexp_extract_all(visible_html, F.lit(AROUND), 0), F.split(visible_html, AROUND, -1)
    start = F.struct(F.lit(0).alias("depth"), F.slice(parts, 1, 1).alias("kept"))

    def step(state, i):
        depth = F.greatest(F.lit(0), state["depth"] + F.when(F.startswith(F.get(tags, i), F.lit("</")), -1).otherwise(1))
        kept = F.when(depth == 0, F.concat(state["kept"], F.slice(parts, i + 2, 1))).otherwise(state["kept"])
        return F.struct(depth.alias("depth"), kept.alias("kept"))

    places = F.when(F.size(tags) > 0, F.sequence(F.lit(0), F.size(tags) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step)["kept"]


def main_text(parts: Column) -> Column:
    """The running text of a page's ``parts``, its blocks joined by a space; character references stay.

    A block is what stands between two block tags. It is running text if it has
    ``BLOCK_LENGTH`` characters or more, of which one in ``LINKED`` at most is linked.
    """
    blocks = F.split(F.array_join(parts, "<p>"), BLOCK, -1)

    def measured(block):
        links = F.array_join(F.regexp_extract_all(block, F.lit(LINK), 1), "")
        return F.struct(strip(F.regexp_replace(block, TAG, "")).alias("text"), F.char_length(F.regexp_replace(links, TAG, "")).alias("linked"))

    def running(block):
        return (F.char_length(block["text"]) >= BLOCK_LENGTH) & (block["linked"] * LINKED <= F.char_length(block["text"]))

    return F.array_join(F.transform(F.filter(F.transform(blocks, measured), running), lambda b: b["text"]), " ")
