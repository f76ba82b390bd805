"""Quality rules as weak supervision.

Each rule votes bad or good on a document, or abstains. A two-class model in the manner of Dawid and Skene says how often each
rule votes on good and on bad documents; expectation-maximisation fits it, without labels, to the counts of all
vote patterns of the corpus. A document's posterior probability of being good replaces the demand that all rules pass.
Each of the nine rules votes or abstains, so there are at most 2 ** 9 patterns, whatever the corpus: only their counts are gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import support

#: The white space between words, and the characters that count as symbols.
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
WINDOW = 5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct", "n_shouts")

#: Rule: (vote, ratio, limit, how often it is expected to cast that vote on bad and on good documents). It votes bad
#: above its limit, or good up to it, and abstains otherwise, also where there is nothing to divide by.
BAD, ABSTAINS, GOOD = "0", "1", "2"
RULES: dict[str, tuple[str, str, float, float, float]] = {
    "symbols": (BAD, "n_symbols / n_words", 0.2, 0.3, 0.0005),
    "capitals": (BAD, "n_upper / n_letters", 0.5, 0.3, 0.0005),
    "shouts": (BAD, "n_shouts / n_words", 0.2, 0.3, 0.0005),
    "repeats": (BAD, "n_repeat_words / n_words", 0.2, 0.3, 0.01),
    "sameness": (BAD, "(n_words - n_distinct) / n_words", 0.75, 0.3, 0.01),
    "dup_lines": (BAD, "n_dup_lines / n_lines", 0.3, 0.3, 0.05),
    "long_words": (BAD, "word_chars / n_words", 14, 0.2, 0.02),
    "short_words": (GOOD, "word_chars / n_words", 9, 0.6, 0.95),
    "varied": (GOOD, "(n_words - n_distinct) / n_words", 0.55, 0.6, 0.95),
}
#: Share of good documents before the data speak, and how many documents of each class all these expectations count for,
#: whatever the size of the corpus: a large one outweighs them. What is expected on good documents is also a limit: no rule
#: may be found to err on them more often than that. It keeps "good" and "bad" from changing places, or from being taken for
#: two kinds of bad documents; a limit at the rate on bad documents does not (about half of the bad ones are kept then).
GOOD_SHARE, PRIOR = 0.8, 1000.0
ROUNDS, TOLERANCE = 500, 1e-10


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, the first finding included."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(word, len(number)) for word in words], np.int64)
    # Pairs of numbers get numbers of their own, so windows are compared exactly however long they are.
    key = ids[: len(ids) - window + 1]
    for place in range(1, window):
        key = np.unique(key * len(number) + ids[place : len(ids) - window + 1 + place], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, np.flatnonzero(twice), 1)
    np.add.at(marks, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The features of one whole text, in the order of ``FEATURES``."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    kept = text.translate(None, SPACE)
    starts = len(kept) - len(re.findall(rb"[\x80-\xbf]", kept)) if not kept.isascii() else len(kept)
    letters = len(kept.translate(None, bytes(b for b in range(256) if not chr(b).isascii() or not chr(b).isalpha())))
    lower = kept.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return (
        len(words),
        starts,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(kept) - len(lower),
        letters,
        len(set(words)),
        text.count(b"!!"),
    )


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``FEATURES`` of every whole text; a null text counts as empty."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure(text) for text in support.bytes_of(batch.column("text"))], np.int64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in found.T]], ["doc_id", *FEATURES])

    return support.whole_texts(docs).mapInArrow(measured, "doc_id long, " + ", ".join(f"{name} long" for name in FEATURES))


def votes() -> Column:
    """Votes of all rules as a text of digits, in the order of ``RULES``."""
    cast = []
    for vote, ratio, limit, _, _ in RULES.values():
        top, bottom = ratio.rsplit(" / ", 1)
        value = F.try_divide(F.expr(top), F.expr(bottom)).cast("double")
        cast.append(F.when(value > limit if vote == BAD else value <= limit, vote).otherwise(ABSTAINS))
    return F.concat(*cast)


def posteriors(patterns: list[str], counts: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of good for each pattern; how often each rule votes on bad and on good documents; share of good ones."""
    voted = np.array([[c != ABSTAINS for c in p] for p in patterns], float).reshape(-1, len(RULES))
    weight = np.array(counts, float)
    expected = np.array([rule[3:] for rule in RULES.values()]).T
    warns = np.array([rule[0] == BAD for rule in RULES.values()])
    rates, share, good = expected.copy(), GOOD_SHARE, np.full(len(voted), -1.0)
    for _ in range(ROUNDS):
        logs = voted @ np.log(rates).T + (1 - voted) @ np.log(1 - rates).T + np.log([1 - share, share])
        now = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        if np.abs(now - good).max(initial=0) < TOLERANCE:
            break
        good = now
        held = np.array([(1 - good) * weight, good * weight])
        share = float((held[1].sum() + PRIOR * GOOD_SHARE) / (weight.sum() + PRIOR))
        rates = (held @ voted + PRIOR * expected) / (held.sum(axis=1, keepdims=True) + PRIOR)
        rates[1] = np.where(warns, np.minimum(rates[1], expected[1]), np.maximum(rates[1], expected[1]))
    return good, rates, share


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``FEATURES``, ``votes``, ``quality`` (probability of good), ``base_failed``, ``kept``, for every row.

    Fewer than ten words, or more than a fifth of the words in repeated windows, fail whatever the votes. Empty and null
    texts have no words, so they fail. Equal texts get equal results. An empty table gives no rows.
    """
    known = support.staged(features(docs).withColumn("votes", votes()), "votes")
    counted = known.groupBy("votes").count().collect()  # at most 2 ** 9 rows
    rows = sorted((row["votes"], row["count"]) for row in counted)
    quality, _, _ = posteriors([p for p, _ in rows], [n for _, n in rows])
    table = docs.sparkSession.createDataFrame([(p, float(q)) for (p, _), q in zip(rows, quality, strict=True)], "votes string, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = known.join(F.broadcast(table), "votes")
    return judged.select("doc_id", *FEATURES, "votes", "quality", failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"))
