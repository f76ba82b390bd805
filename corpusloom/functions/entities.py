"""Rule-based entity mentions. A trained extractor can take their place through ``operators.hooks``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_LABELS = ("PERSON", "ORG", "GPE", "LOC")
ALL_LABELS = NAME_LABELS + ("EVENT", "DATE", "MONEY")

NAME_PATTERN = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*"
WORD_PATTERN = r"\p{Lu}\p{Ll}+"
_MONTH = (
    "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
)
# The look-ahead lets the search skip a position by its first character.
DATE_PATTERN = (
    rf"(?=[0-9JFMASOND])(?:{_MONTH} [0-9]{{1,2}}, [0-9]{{4}}|[0-9]{{1,2}} {_MONTH} [0-9]{{4}}|{_MONTH} [0-9]{{4}}"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2})"
)
MONEY_PATTERN = (
    r"(?=[$€£₹RUEI])(?:[$€£₹]|Rs\.?|USD|EUR|INR) ?[0-9][0-9,]*(?:\.[0-9]+)?(?: (?:million|billion|crore|lakh))?"
)


def mentions(text: Column, pattern: str = NAME_PATTERN) -> Column:
    """Distinct lower-case matches of ``pattern`` in the whole text, sorted; empty for NULL text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(found, lambda m: F.lower(m))))


def parts(runs: Column, longest: int) -> Column:
    """Distinct parts of ``runs``, arrays of blank-separated words, that have up to ``longest`` words."""

    def of(words: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.size(words), F.lit(longest)))
        pick = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.flatten(F.transform(sizes, pick))

    return F.array_distinct(F.flatten(F.transform(runs, lambda run: of(F.split(run, " ")))))
