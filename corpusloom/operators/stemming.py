"""Porter's suffix stripping for English, as columns over a table of distinct tokens.

Stems are computed once per distinct token and joined to texts, so the cost follows the vocabulary rather
than the corpus. The rules are those of M. F. Porter, "An algorithm for suffix stripping" (1980), with the
extensions the usual toolkits add.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.shared import computed_once

# Words with a stem of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
# Suffix -> replacement, tried in order; the first suffix that fits decides.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
)

Rule = tuple[str, str, Callable[["Word"], Column]]


def _shape_by_letter(word: Column) -> Column:
    return F.aggregate(
        F.split(word, ""),
        F.lit(""),
        lambda shape, letter: F.concat(
            shape,
            F.when(letter == "", "")
            .when(letter.isin("a", "e", "i", "o", "u") | ((letter == "y") & shape.endswith("c")), "v")
            .otherwise("c"),
        ),
    )


def _shape(word: Column) -> Column:
    """``c`` or ``v`` per letter; y is a vowel after a consonant.

    Only a double y needs the letters to be gone through one by one.
    """
    marked = F.translate(word, "aeiouv", "vvvvvc")
    consonant_y = F.regexp_replace(marked, "(^|v)y", "$1c")
    quick = F.regexp_replace(F.translate(consonant_y, "y", "v"), "[^v]", "c")
    return F.when(F.contains(word, F.lit("yy")), _shape_by_letter(word)).otherwise(quick)


class Word:
    """A word column, its shape column, and the tests the rules make on them."""

    def __init__(self, text: Column, shape: Column):
        self.text = text
        self.shape = shape

    def without(self, suffix: str) -> Word:
        kept = F.length(self.text) - len(suffix)
        return Word(F.substring(self.text, F.lit(1), kept), F.substring(self.shape, F.lit(1), kept))

    def measure(self) -> Column:
        return F.regexp_count(self.shape, F.lit("vc"))

    def has_vowel(self) -> Column:
        return F.contains(self.shape, F.lit("v"))

    def last(self, n: int = 1) -> Column:
        return F.substring(self.text, -n, 1)

    def double_consonant(self) -> Column:
        return (F.length(self.text) > 1) & (self.last(1) == self.last(2)) & self.shape.endswith("c")

    def short_end(self) -> Column:
        return (self.shape.endswith("cvc") & ~self.last().isin("w", "x", "y")) | (self.shape == "vc")


def _apply(word: Word, rules: list[Rule]) -> Column:
    """The first rule whose suffix fits decides: replace it if the stem passes the test, else keep the word."""
    result = None
    for suffix, replacement, test in rules:
        stem = word.without(suffix)
        outcome = F.when(test(stem), F.concat(stem.text, F.lit(replacement))).otherwise(word.text)
        fits = word.text.endswith(suffix)
        result = F.when(fits, outcome) if result is None else result.when(fits, outcome)
    return result.otherwise(word.text)


def _always(stem: Word) -> Column:
    return F.lit(True)


def _positive(stem: Word) -> Column:
    return stem.measure() > 0


def _plural(word: Word) -> Column:
    short = word.text.endswith("ies") & (F.length(word.text) == 4)
    rules = [("sses", "ss", _always), ("ies", "i", _always), ("ss", "ss", _always), ("s", "", _always)]
    return F.when(short, F.concat(word.without("ies").text, F.lit("ie"))).otherwise(_apply(word, rules))


def _past(word: Word) -> Column:
    """Strip ``ed`` and ``ing``; a word they are cut from is marked with ``*`` for ``_repair``."""
    ied = F.concat(word.without("ied").text, F.when(F.length(word.text) == 4, "ie").otherwise("i"))
    eed, ed, ing = (word.without(s) for s in ("eed", "ed", "ing"))
    return (
        F.when(word.text.endswith("ied"), ied)
        .when(word.text.endswith("eed"), F.when(_positive(eed), F.concat(eed.text, F.lit("ee"))).otherwise(word.text))
        .when(word.text.endswith("ed") & ed.has_vowel(), F.concat(ed.text, F.lit("*")))
        .when(word.text.endswith("ing") & ing.has_vowel(), F.concat(ing.text, F.lit("*")))
        .otherwise(word.text)
    )


def _repair(word: Word) -> Column:
    """Give a word cut by ``_past`` a regular end."""
    cut = word.without("*")
    doubled = F.when(~cut.last().isin("l", "s", "z"), cut.without("?").text).otherwise(cut.text)
    mended = (
        F.when(cut.text.endswith("at") | cut.text.endswith("bl") | cut.text.endswith("iz"), F.concat(cut.text, F.lit("e")))
        .when(cut.double_consonant(), doubled)
        .when((cut.measure() == 1) & cut.short_end(), F.concat(cut.text, F.lit("e")))
        .otherwise(cut.text)
    )
    return F.when(word.text.endswith("*"), mended).otherwise(word.text)


def _final_y(word: Word) -> Column:
    return _apply(word, [("y", "i", lambda s: (F.length(s.text) > 1) & s.shape.endswith("c"))])


def _alli(word: Word) -> Column:
    return _apply(word, [("alli", "al", _positive)])


def _double_suffix(word: Word) -> Column:
    # The test of "logi" looks at the word up to its "l".
    logi = ("logi", "log", lambda s: word.without("ogi").measure() > 0)
    return _apply(word, [*[(a, b, _positive) for a, b in STEP_2], logi])


def _suffix(word: Word) -> Column:
    return _apply(word, [(a, b, _positive) for a, b in STEP_3])


def _long_suffix(word: Word) -> Column:
    def test(suffix: str):
        if suffix == "ion":
            return lambda s: (s.measure() > 1) & s.last().isin("s", "t")
        return lambda s: s.measure() > 1

    return _apply(word, [(suffix, "", test(suffix)) for suffix in STEP_4])


def _final_e(word: Word) -> Column:
    return _apply(word, [("e", "", lambda s: (s.measure() > 1) | ((s.measure() == 1) & ~s.short_end()))])


def _final_ll(word: Word) -> Column:
    return _apply(word, [("ll", "l", lambda s: word.without("l").measure() > 1)])


STEPS = (_plural, _past, _repair, _final_y, _alli, _double_suffix, _suffix, _long_suffix, _final_e, _final_ll)


def counted_stems(tokens: DataFrame, min_len: int = 4) -> DataFrame:
    """``(token, stem, n)`` of the distinct tokens of at least ``min_len`` letters, and how often they occur.

    Every step is finished before the next one starts from it; nested in one expression, each would run
    the one before it once per use.
    """
    words = tokens.where(F.length("token") >= min_len).groupBy("token").agg(F.count("*").alias("n")).withColumn("_word", F.col("token"))
    for step in STEPS:
        shaped = computed_once(words, {"_shape": _shape(F.col("_word"))})
        words = computed_once(shaped, {"_word": step(Word(F.col("_word"), F.col("_shape")))}).drop("_shape")
    special = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return words.select("token", F.coalesce(F.try_element_at(special, F.col("token")), F.col("_word")).alias("stem"), "n")


def stem_table(tokens: DataFrame, min_len: int = 4) -> DataFrame:
    """``(token, stem)`` of the distinct tokens of at least ``min_len`` letters that differ from their stem."""
    return counted_stems(tokens, min_len).where("token <> stem").select("token", "stem")
