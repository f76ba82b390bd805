"""Arithmetic on ARRAY columns of numbers, carried out in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it per array element."""
    return F.transform(F.array(value), body).getItem(0)


def softmax(values: Column) -> Column:
    """Softmax of an array, shifted by its largest element so that it cannot overflow."""
    shifted = let(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))
    return let(
        shifted,
        lambda e: let(
            F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total)
        ),
    )


def hashed_counts(words: Column, dims: int = 64) -> Column:
    """Bag of words as counts over ``dims`` cells; the cell comes from first letter, last letter, length.

    A model-free stand-in for a sentence encoder.
    """
    cells = F.transform(
        F.filter(words, lambda w: w != ""),
        lambda w: F.pmod(
            F.ascii(F.substring(w, 1, 1)) * 31 + F.ascii(F.substring(w, -1, 1)) * 7 + F.length(w), F.lit(dims)
        ),
    )
    return let(
        cells,
        lambda found: F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda d: F.size(F.filter(found, lambda c: c == d)).cast("double"),
        ),
    )
