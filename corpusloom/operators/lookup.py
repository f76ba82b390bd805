"""Tokens replaced by a value of their own, such as an id or a stem, where their texts lie."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.shared import DICTIONARY_BYTES, common_part, dictionary_bytes, stored

#: Bytes of texts whose tokens a task holds at a time, whatever Spark's batches hold. Changes no result.
PART_BYTES = 1_000_000


def _known(table: DataFrame) -> Broadcast[tuple[pa.Array, pa.Array]]:
    """The rows of a table ``(token, value)`` in every task: two Arrow columns, which take there no more than their bytes."""
    rows = table.where(F.col(table.columns[1]).isNotNull()) if table.dtypes[1][1] == "string" else table
    found = rows.toArrow()
    return table.sparkSession.sparkContext.broadcast(tuple(column.combine_chunks() for column in found.columns))


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of parts of about ``PART_BYTES``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // PART_BYTES)) + 1).tolist(), len(texts)]
    return ((start, end - start) for start, end in pairwise(cuts) if end > start)


def _offsets(lists: pa.Array) -> np.ndarray:
    """Where each list begins and the last one ends; a null one is empty."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])


def _tokens(lines: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where the tokens of each line begin, and the tokens of all; an empty line has none."""
    lists = pc.split_pattern(pc.if_else(pc.equal(lines, ""), None, lines), " ")
    return _offsets(lists), lists.flatten().dictionary_encode()


def _places(tokens: pa.Array, keys: pa.Array) -> np.ndarray:
    """Of distinct tokens among the keys, the last one where a key repeats; -1 if there is none."""
    # The keys are looked up among the tokens, so that the table made for this is as small as a part of the texts.
    which = pc.fill_null(pc.index_in(keys, value_set=tokens, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
    real = np.flatnonzero(which >= 0)
    places = np.full(len(tokens), -1)
    places[which[real]] = real
    return places


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _rare_tokens(known: Broadcast, min_len: int):
    """Arrow function: the distinct tokens of lines that the dictionary does not hold."""

    def of(lines: pa.Array, keys: pa.Array) -> pa.Array:
        starts, tokens = _tokens(pc.replace_substring(lines, "\n", " "))
        distinct, codes = tokens.dictionary, tokens.indices.to_numpy()
        length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
        wanted = ((_places(distinct, keys) < 0) & (length >= max(min_len, 1)))[codes]
        row = np.repeat(np.arange(len(lines)), np.diff(starts))
        row, code = np.divmod(np.unique(row[wanted] * len(distinct) + codes[wanted]), max(len(distinct), 1))
        return _lists(np.searchsorted(row, np.arange(len(lines) + 1)), distinct.take(pa.array(code)))

    @F.arrow_udf("array<string>")
    def rare(texts: pa.Array) -> pa.Array:
        keys, _ = known.value
        return pa.concat_arrays([pa.array([], pa.list_(pa.string())), *(of(texts.slice(*part), keys) for part in _parts(texts))])

    return rare


def _replaced(rows: DataFrame, name: str, known: Broadcast, kind: str, missing: Callable) -> DataFrame:
    """``(..., text, keys, found)``: lines, and tokens of their own with values -> ``(..., name)``: for each line an array of ids, or its text.

    What a task holds is Spark's batch and the tokens of one part of it: each part is passed on before the next one is made.
    """
    ids = kind == "int"
    item = pa.int32() if ids else pa.string()
    made = T.ArrayType(T.ArrayType(T.IntegerType()) if ids else T.StringType())
    kept = rows.schema.fields[:-3]
    names = [*(field.name for field in kept), name]

    def of(texts: pa.Array, own: dict) -> pa.Array:
        keys, values = known.value
        lines = pc.split_pattern(texts, "\n")
        starts, tokens = _tokens(lines.flatten())
        places = _places(tokens.dictionary, keys)
        held = places >= 0
        told = [(t, own.get(t)) for t in tokens.dictionary.filter(pa.array(~held)).to_pylist()]
        told = pa.array([missing(t) if value is None else value for t, value in told], item)
        order = np.empty(len(held), dtype=np.int64)
        order[held], order[~held] = np.arange(held.sum()), held.sum() + np.arange(len(told))
        distinct = pa.concat_arrays([values.take(pa.array(places[held])), told]).take(pa.array(order))
        found = _lists(starts, distinct.take(tokens.indices))
        return _lists(_offsets(lines), found if ids else pc.binary_join(found, " "))

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch.column(len(kept))):
                *others, texts, keys, found = batch.slice(*part).columns
                own = dict(zip(keys.flatten().to_pylist(), found.flatten().to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays([*others, of(texts, own)], names)

    return rows.mapInArrow(replaced, T.StructType([*kept, T.StructField(name, made)]))


def looked_up(
    df: DataFrame, keep: list[str], lines: dict[str, Column], table: DataFrame, missing: Callable, max_bytes: int = DICTIONARY_BYTES, min_len: int = 1
) -> DataFrame:
    """``(keep..., name)``: a text of lines of blank-separated tokens with their values, for each line an array of ids, or a text again.

    ``table``, a checkpointed one, is ``(token, value, order)``, ``missing`` gives the value of a token that it does not hold. If it holds at most ``max_bytes``
    it goes to the tasks as a dictionary, and nothing moves. Of a larger one, the dictionary takes the rows with the smallest
    ``order``, best the most frequent tokens. The texts are then stored once; each other token of at least ``min_len`` characters that a text
    has is one row, is joined to ``table``, and comes back to its text by the number of the stored row. So what moves is the
    texts and their rare tokens, not a row a token, and no token can be hot.
    """
    (name, text), = lines.items()
    key, value, order = table.columns
    kind = dict(table.dtypes)[value]
    nothing = F.lit(None).cast("array<string>").alias("_keys"), F.lit(None).cast(f"array<{kind}>").alias("_values")
    if dictionary_bytes(table.select(key, value)) <= max_bytes:
        known = _known(table.select(key, value))
        return _replaced(df.select(*keep, text.alias("_lines"), *nothing), name, known, kind, missing)
    known = _known(common_part(table, order, max_bytes).select(key, value))
    rows = stored(df.select(*keep, text.alias("_lines"), F.monotonically_increasing_id().alias("_row")), "lines")
    rare = rows.select("_row", F.explode(_rare_tokens(known, min_len)("_lines")).alias(key))
    pair = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    found = rare.join(table.select(key, value), key).groupBy("_row").agg(F.collect_list(pair).alias("_own"))
    own = F.transform("_own", lambda p: p["k"]).alias("_keys"), F.transform("_own", lambda p: p["v"]).alias("_values")
    both = rows.join(found, "_row", "left")
    return _replaced(both.select(*keep, "_lines", *own), name, known, kind, missing)
