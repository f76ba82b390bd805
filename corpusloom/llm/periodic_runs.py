"""Runs of repeated words, found by recompression.

The words of a batch of texts, each text closed by a symbol of its own, are compressed in alternating rounds: every block of
equal symbols becomes one symbol, then every pair of a left and a right symbol (the sides are drawn anew in each round)
becomes one. The rules of all rounds are a run-length grammar of the batch. Equal stretches are compressed alike but for
a few symbols at their ends, so the grammar tells how far two places agree, forwards or backwards, by looking at one
symbol (or one block) a round on the way up, and again on the way down.

A run of period p that is at least ``TIMES * p`` words long covers some place i on the grid of multiples of
``(TIMES - 1) * p`` with its word i + p. Over all periods these harmonic grids have n log n places; where the two words are
equal, the grammar gives both exact extensions, and the run with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import support

#: A run is at least ``TIMES`` periods and ``LEAST`` words long.
TIMES, LEAST = 4, 6
#: Bytes of text that one grammar covers (a longer text has one of its own), and places of the grids that are looked at
#: together. They bound memory and change no result.
GRAMMAR_BYTES, PLACES = 4_000_000, 1_000_000
RUN = "struct<start: long, length: long, period: long>"


class Round(NamedTuple):
    """Symbols before a round; for each, the symbol it went into; for each of these, its first one. The last two have
    one entry more, for the end."""

    symbols: np.ndarray
    into: np.ndarray
    first: np.ndarray
    blocks: bool


def _folded(symbols: np.ndarray, starts: np.ndarray, blocks: bool) -> tuple[Round, np.ndarray]:
    """A round that joins the symbols from each start up to the next one, and the symbols after it."""
    first = np.append(np.flatnonzero(starts), len(symbols))
    into = np.append(np.cumsum(starts) - 1, len(first) - 1)
    sizes = np.diff(first)
    if blocks:
        second = sizes
    else:
        second = np.where(sizes == 2, symbols[np.minimum(first[:-1] + 1, len(symbols) - 1)] + 1, 0)
    names = pd.factorize(symbols[first[:-1]] * (int(second.max()) + 1) + second)[0]
    return Round(symbols, into, first, blocks), names


def grammar(symbols: np.ndarray) -> list[Round]:
    """Rounds until no symbol is left twice. ``symbols`` are small numbers that begin and end with one found nowhere else."""
    rounds: list[Round] = []
    count = 0
    while len(symbols) and np.bincount(symbols).max() > 1:
        starts = np.append(True, symbols[1:] != symbols[:-1])
        if not starts.all():
            done, symbols = _folded(symbols, starts, True)
            rounds.append(done)
        count += 1
        drawn = (symbols.astype(np.uint64) + np.uint64(count << 40)) * np.uint64(0x9E3779B97F4A7C15)
        left = ((drawn ^ drawn >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63) == 0
        starts = np.append(True, ~(left[:-1] & ~left[1:]))
        if not starts.all():
            done, symbols = _folded(symbols, starts, False)
            rounds.append(done)
    return rounds


def _step(r: Round, a: np.ndarray, b: np.ndarray, back: int) -> tuple[np.ndarray, np.ndarray]:
    """How many symbols agree next to ``a`` and ``b`` (up to the end of a block), and where blocks differ in length."""
    same = r.symbols[a - back] == r.symbols[b - back]
    if not r.blocks:
        return same.astype(np.int64), np.zeros(len(a), bool)
    if back:
        m, n = a - r.first[r.into[a - 1]], b - r.first[r.into[b - 1]]
    else:
        m, n = r.first[r.into[a] + 1] - a, r.first[r.into[b] + 1] - b
    return np.where(same, np.minimum(m, n), 0), same & (m != n)


def agreement(rounds: list[Round], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols agree from each place ``a`` and ``b`` onwards, or just before them (``back``); ``a`` is not ``b``."""
    here, there, sign = a.copy(), b.copy(), -1 if back else 1
    top = np.full(len(a), len(rounds))
    alive = np.arange(len(a))
    for level, r in enumerate(rounds):
        if not len(alive):
            break
        x, y = here[alive], there[alive]
        inside = np.flatnonzero((r.first[r.into[x]] != x) | (r.first[r.into[y]] != y))
        agree, uneven = _step(r, x[inside], y[inside], int(back))
        x[inside] += sign * agree
        y[inside] += sign * agree
        over = np.zeros(len(alive), bool)
        over[inside] = uneven | (agree == 0)
        here[alive], there[alive] = np.where(over, x, r.into[x]), np.where(over, y, r.into[y])
        top[alive[over]] = level
        alive = alive[~over]
    for level in range(len(rounds) - 1, -1, -1):
        r = rounds[level]
        down = np.flatnonzero(top > level)
        x, y = r.first[here[down]], r.first[there[down]]
        agree, _ = _step(r, x, y, int(back))
        here[down], there[down] = x + sign * agree, y + sign * agree
    return (here - a) * sign


def _grids(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All places of all grids, in portions: number of the text, period, place in the text."""
    longest = np.where(sizes >= LEAST, sizes // TIMES, 0)
    text = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    wide = (TIMES - 1) * period
    places = -(-(sizes[text] - period) // wide)
    ends = np.cumsum(places)
    first = 0
    while first < len(text):
        begun = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begun + PLACES, "right")))
        part = slice(first, last)
        which = np.repeat(np.arange(first, last), places[part])
        nth = np.arange(len(which)) - np.repeat(ends[part] - places[part] - begun, places[part])
        yield text[which], period[which], nth * wide[which]
        first = last


def runs_of(words: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    """All runs in texts whose words, as numbers from 0, stand one after the other: ``text``, ``start``, ``length``,
    ``period``, ordered by text, start and period."""
    begin = np.cumsum(sizes) - sizes + np.arange(len(sizes)) + 1
    closed = np.zeros(len(words) + len(sizes) + 1, np.int64)
    ends = np.append(0, begin + sizes)
    is_word = np.ones(len(closed), bool)
    is_word[ends] = False
    closed[is_word] = words
    closed[ends] = (int(words.max()) + 1 if len(words) else 0) + np.arange(len(ends))
    rounds = grammar(closed)
    found = []
    for text, period, place in _grids(sizes):
        i = begin[text] + place
        equal = closed[i] == closed[i + period]
        text, period, i = text[equal], period[equal], i[equal]
        start = i - agreement(rounds, i, i + period, back=True)
        length = i + period + agreement(rounds, i, i + period) - start
        long = length >= np.maximum(LEAST, TIMES * period)
        found.append(np.stack([text, start - begin[text], length, period], axis=1)[long])
    table = pd.DataFrame(np.concatenate(found) if found else np.zeros((0, 4), np.int64), columns=["text", "start", "length", "period"])
    # A multiple of a run's period gives the same stretch again; the smallest is its period.
    table = table.sort_values(["text", "start", "length", "period"]).drop_duplicates(["text", "start", "length"])
    return table.sort_values(["text", "start", "period"], ignore_index=True)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one in ten ids, which word stands in each place once a stretch is repeated to the end; else None."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or n == 0:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places < a, places, a + (places - a) % p)


def find_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Rows of (``doc_id``, ``n_words``, ``runs``, ``collapsed``), one for each document.

    ``runs`` are all stretches of consecutive words with smallest period q, at least ``max(LEAST, TIMES * q)`` long, that no
    neighbouring word extends; ordered by start, then period. ``collapsed`` is the text without the words that some run holds
    after its first q, joined by single blanks. With ``plant`` the words of one in ten ids are first made periodic.

    A null or empty text has no words, no runs and an empty ``collapsed``. Rows without an id are judged like all others, but
    nothing is planted in them. Repeated rows are judged one by one. Long texts are judged whole.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in support.slices(batch, "text", GRAMMAR_BYTES):
                yield from judged(part)

    def judged(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, sizes = support.words_of(part.column("text"))
        numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        ids, begin = part.column("doc_id").to_pylist(), np.cumsum(sizes) - sizes
        source: dict[int, np.ndarray] = {}
        for k, (doc_id, n) in enumerate(zip(ids, sizes.tolist(), strict=True)):
            if plant and (places := planted(doc_id, n)) is not None:
                source[k] = places
                numbers[begin[k] : begin[k] + n] = numbers[begin[k] + places]
        runs = runs_of(numbers, sizes)
        changes = np.zeros(len(numbers) + 1, np.int64)
        at = begin[runs["text"]] + runs["start"].to_numpy()
        np.add.at(changes, at + runs["period"].to_numpy(), 1)
        np.add.at(changes, at + runs["length"].to_numpy(), -1)
        order = np.arange(len(numbers))
        for k, places in source.items():
            order[begin[k] : begin[k] + len(places)] = begin[k] + places
        kept = np.cumsum(changes)[:-1] == 0
        left = np.append(0, np.cumsum(kept))[np.append(begin, len(numbers))].astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), words.take(pa.array(order[kept]))), " ")
        lists = np.append(0, np.cumsum(np.bincount(runs["text"], minlength=len(sizes)))).astype(np.int32)
        fields = [pa.array(runs[name].to_numpy()) for name in ("start", "length", "period")]
        listed = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), listed, texts], ["doc_id", "n_words", "runs", "collapsed"])

    return support.whole_texts(docs).mapInArrow(found, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def greatest(runs: Column) -> Column:
    """The run with the greatest ratio of length to period, compared exactly; the first of equal ones; null without runs."""
    more = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, run: F.when(more(best, run), run).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """One row a document: the number of runs, the greatest of them, and hashes of all runs and of the collapsed text."""
    line = lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])
    best = F.col("_best")
    return found.withColumn("_best", greatest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[name].alias(name) for name in ("start", "length", "period")],
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", lambda run: F.concat(line(run), F.lit("\n")))).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
