"""Sentence splitting and the packed sentence form used by model inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 30
SEPARATOR = "|||"


def split_sentences(text: Column, min_len: int = 10) -> Column:
    """Sentences whose trimmed length exceeds ``min_len``, in order. Expects collapsed text.

    A sentence ends at ``.``, ``!`` or ``?`` followed by a blank.
    """
    parts = F.transform(F.split(text, "(?<=[.!?]) +"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > min_len)


def first_sentences(sentences: Column, n: int = SLOTS) -> Column:
    return F.slice(sentences, 1, n)


def pad_slots(sentences: Column, n: int = SLOTS) -> Column:
    """The first ``n`` sentences, filled up with empty strings to exactly ``n``."""
    head = F.slice(sentences, 1, n)
    return F.concat(head, F.array_repeat(F.lit(""), F.greatest(F.lit(n) - F.size(head), F.lit(0))))


def pack(sentences: Column, n: int = SLOTS) -> Column:
    return F.array_join(pad_slots(sentences, n), SEPARATOR)


def unpack(packed: Column) -> Column:
    return F.split(packed, r"\|\|\|")


def count_filled(packed: Column) -> Column:
    """Number of slots that hold more than blanks."""
    return F.size(F.filter(unpack(packed), lambda s: F.trim(s) != "")).cast("bigint")


def slot_mask(packed: Column, n: int = SLOTS) -> Column:
    """1 for the first ``count_filled`` of ``n`` slots, 0 for the rest."""
    filled = F.least(count_filled(packed).cast("int"), F.lit(n))
    return F.concat(F.array_repeat(F.lit(1), filled), F.array_repeat(F.lit(0), F.lit(n) - filled))


def packed_to_text(packed: Column) -> Column:
    return F.replace(packed, F.lit(SEPARATOR), F.lit(" "))
