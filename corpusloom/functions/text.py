"""Text cleaning and tokenization as column expressions.

Every function maps a string column to a column and stays inside whole-stage code generation where
Spark's own functions do. NULL stays NULL unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters other than the blank that count as white space (Unicode's, as for Python
# strings). Spelled out because the short class means ASCII only in Java.
_OTHER_SPACE = r"\t-\r\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITESPACE = rf"[ {_OTHER_SPACE}]"

# The 28 words that never are keywords.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "and", "or", "but",
    "has", "have", "had", "with", "from", "by", "that", "this", "it", "its", "be", "been",
)


def _single_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "  ++", " "))


def blank_space(text: Column) -> Column:
    """Every white space character becomes a blank."""
    return F.regexp_replace(text, f"[{_OTHER_SPACE}]", " ")


def collapse_space(text: Column) -> Column:
    """Runs of white space become one blank; none is left at either end.

    Single blanks, by far the most frequent case, are never rewritten.
    """
    return _single_blanks(blank_space(text))


def strip_tags(text: Column) -> Column:
    """Drop ``<...>``. Words on both sides of a tag join; script and style bodies stay."""
    return F.regexp_replace(text, "<[^>]++>", "")


def blank_named_entities(text: Column) -> Column:
    """``&amp;`` and the like become a blank; they are not decoded."""
    return F.regexp_replace(text, "&[a-zA-Z]++;", " ")


def blank_numeric_entities(text: Column) -> Column:
    """Decimal references (``&#39;``) become a blank; the hexadecimal form stays."""
    return F.regexp_replace(text, "&#[0-9]++;", " ")


def _blank_entities_and_space(text: Column) -> Column:
    """Both kinds of entity and every white space character become a blank, in one pass.

    The result equals replacing them one kind after the other: a blank never completes an entity.
    """
    return F.regexp_replace(text, rf"&(?:[a-zA-Z]++|#[0-9]++);|[{_OTHER_SPACE}]", " ")


def clean_html(text: Column) -> Column:
    """Tags, entities, white space."""
    return _single_blanks(_blank_entities_and_space(strip_tags(text)))


def strip_urls(text: Column) -> Column:
    """Drop ``http...`` and ``www....`` up to the next blank. Blanks must be the only white space."""
    return F.regexp_replace(text, r"http[^ ]++|www\.[^ ]++", "")


def strip_emails(text: Column) -> Column:
    """Drop tokens with an ``@`` that is neither first nor last. Blanks must be the only white space.

    The match is tied to the start of a token, which keeps it linear on long tokens.
    """
    return F.regexp_replace(text, "(?<![^ ])(?:[^ @]++@[^ ]++|@[^ @]*+@[^ ]++)", "")


def clean_text(text: Column) -> Column:
    """Markup, then URLs, then e-mail addresses, then white space."""
    return _single_blanks(strip_emails(strip_urls(_blank_entities_and_space(strip_tags(text)))))


def tokens(text: Column) -> Column:
    """Whitespace tokens of collapsed text; an empty text has none."""
    return F.filter(F.split(text, " "), lambda token: token != "")


def count_tokens(text: Column, collapsed: bool = False) -> Column:
    """Number of whitespace tokens, 0 for NULL or empty text.

    Counts blanks instead of building the token array.
    """
    flat = text if collapsed else collapse_space(text)
    blanks = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(text.isNull() | (flat == ""), F.lit(0)).otherwise(blanks + 1).cast("bigint")


def count_words(text: Column) -> Column:
    """Number of runs of letters, digits and underscores in any script, 0 for NULL or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")), F.lit(0)).cast("bigint")


def keywords(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct lower-case tokens longer than three characters that are no stop words.

    Punctuation stays part of its token, also when the length is measured. Expects collapsed text.
    """
    kept = F.filter(tokens(text), lambda t: (F.length(t) > 3) & ~F.lower(t).isin(*stop_words))
    return F.sort_array(F.array_distinct(F.transform(kept, lambda t: F.lower(t))))


def excerpt(text: Column, n: int) -> Column:
    """The first ``n`` characters, for display in a report."""
    return F.substring(text, 1, n)
