"""Token-id files in Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector, which says how many ids share the other 60 bits: 60 of 1 bit, 30 of 2, ... , 1 of
60. Selector 0 is the escape: the word's payload is the place of one raw 64-bit value behind the packed words of its
block. A block holds ``BLOCK`` consecutive ids (the last of a segment fewer) and starts on a word, whose number is
stored, so blocks are decoded together, selector by selector, without walking through the words.

A file is a Parquet table with a row a segment: ``shard`` and ``segment`` number it in document order, ``first_id`` counts the
ids of its shard before it, ``doc_ids`` and ``doc_tokens`` list its documents, ``offsets`` has the first word of each block
and the number of words at the end, ``n_raw`` the number of raw words of each block, ``words`` the words in little-endian order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import shared
from corpusloom.llm import support
from corpusloom.llm.token_ids import default_path, encoder

#: Ids a word by selector; 0 marks the escape.
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BLOCK = 1024
SEGMENT = 1 << 18
SCHEMA = "segment int, first_id long, n_ids long, doc_ids array<long>, doc_tokens array<int>, offsets array<int>, n_raw array<int>, words binary"


def _widest(bits: np.ndarray, count: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Per place, the widest of ``count`` values from it on; windows of powers of two are kept in ``known``."""
    power = 1 << (count.bit_length() - 1)
    window = known[power]
    rest = count - power
    return np.maximum(window[:, : window.shape[1] - rest], window[:, rest:]) if rest else window


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block (and the end), raw words of each block, of any unsigned 64-bit integers."""
    ids = np.asarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.empty(0, "<u8"), np.zeros(1, np.int32), np.empty(0, np.int32)
    room = BLOCK + max(COUNTS)
    values = np.zeros((blocks, room), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(ids)] = ids
    values[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = np.zeros(values.shape, np.uint8)
    for shift in range(int(ids.max()).bit_length()):
        bits += values >> np.uint64(shift) != 0
    windows = {1: bits}
    while 2 * max(windows) <= max(COUNTS):
        size = max(windows)
        windows[2 * size] = np.maximum(windows[size][:, :-size], windows[size][:, size:])
    selector = np.zeros((blocks, BLOCK), np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        fits = _widest(bits, COUNTS[s], windows)[:, :BLOCK] <= 60 // COUNTS[s]
        selector[fits] = s
    used = np.maximum(np.array(COUNTS, np.int64), 1)
    ends = np.full(blocks, BLOCK)
    ends[-1] = len(ids) - (blocks - 1) * BLOCK
    at, live, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        chosen = selector[live, at[live]]
        steps.append((live, at[live], chosen))
        at[live] += used[chosen]
        live = live[at[live] < ends[live]]
    block, place, chosen = (np.concatenate(part) for part in zip(*steps, strict=True))
    order = np.lexsort((place, block))
    block, place, chosen = block[order], place[order], chosen[order]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(1, len(COUNTS)):
        here = np.flatnonzero(chosen == s)
        for i in range(COUNTS[s] if len(here) else 0):
            words[here] |= values[block[here], place[here] + i] << np.uint64(i * (60 // COUNTS[s]))
    escaped = chosen == 0
    n_raw = np.bincount(block[escaped], minlength=blocks)
    n_packed = np.bincount(block, minlength=blocks)
    offsets = np.concatenate([[0], np.cumsum(n_packed + n_raw)])
    out = np.zeros(offsets[-1], "<u8")
    raw_before = np.cumsum(n_raw) - n_raw
    out[np.arange(len(words)) + raw_before[block]] = words
    if escaped.any():
        rank = np.arange(escaped.sum()) - raw_before[block[escaped]]
        out[np.flatnonzero(escaped) + raw_before[block[escaped]]] = rank.astype(np.uint64)
        out[offsets[block[escaped]] + n_packed[block[escaped]] + rank] = values[block[escaped], place[escaped]]
    return out, offsets.astype(np.int32), n_raw.astype(np.int32)


def unpack(words: np.ndarray, offsets: np.ndarray, n_raw: np.ndarray, n_ids: int) -> np.ndarray:
    """The integers that ``pack`` was given."""
    blocks = len(offsets) - 1
    if not blocks:
        return np.empty(0, np.uint64)
    offsets, n_raw = offsets.astype(np.int64), n_raw.astype(np.int64)
    sizes = np.diff(offsets) - n_raw
    block = np.repeat(np.arange(blocks), sizes)
    within = np.arange(len(block)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    packed = words[offsets[block] + within]
    chosen = (packed >> np.uint64(60)).astype(np.int64)
    used = np.maximum(np.array(COUNTS, np.int64), 1)[chosen]
    ends = np.cumsum(used)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = ends - used - (ends - used)[first][block]
    values = np.zeros((blocks, BLOCK + max(COUNTS)), np.uint64)
    for s in range(1, len(COUNTS)):
        here = np.flatnonzero(chosen == s)
        width = 60 // COUNTS[s]
        for i in range(COUNTS[s] if len(here) else 0):
            values[block[here], place[here] + i] = packed[here] >> np.uint64(i * width) & np.uint64((1 << width) - 1)
    here = np.flatnonzero(chosen == 0)
    raw = offsets[block[here]] + sizes[block[here]] + (packed[here] & np.uint64((1 << 60) - 1)).astype(np.int64)
    values[block[here], place[here]] = words[raw]
    return values[:, :BLOCK].reshape(-1)[:n_ids]


def _segments(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = zip(*[part.split() for part in SCHEMA.split(", ")], strict=True)
        arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
        schema = pa.schema([(name, arrow[kind]) for name, kind in zip(names, types, strict=True)])
        segment, first, held, ids, docs = 0, 0, 0, [], []

        def row() -> pa.RecordBatch:
            joined = np.concatenate(ids)
            words, offsets, n_raw = pack(joined)
            values = [segment, first, len(joined), docs, [len(part) for part in ids], offsets.tolist(), n_raw.tolist(), words.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for part in support.slices(batch, "text", support.BATCH_BYTES):
                found, sizes = encoder(path).batch(part.column("text"))
                for doc_id, one in zip(part.column("doc_id").to_pylist(), np.split(found, np.cumsum(sizes)[:-1]), strict=True):
                    ids.append(one)
                    docs.append(doc_id)
                    held += len(one)
                    if held >= SEGMENT:
                        yield row()
                        segment, first, held, ids, docs = segment + 1, first + held, 0, [], []
        if ids:
            yield row()

    return encode


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None) -> None:
    """Tokenize whole texts and write them to ``folder`` in ascending ``doc_id`` order, an id 0 behind each document.

    A null text counts as empty and gives the end id alone; a null ``doc_id`` comes first; equal ids keep all their
    rows, ordered by text. An empty table gives a folder without segments.
    """
    rows = support.whole_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    segments = rows.mapInArrow(_segments(tokenizer or default_path()), SCHEMA)
    segments.withColumn("shard", F.spark_partition_id()).write.option("compression", "zstd").parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["shard", "inside", "doc_id", "n_tokens", "ids"]
    for batch in batches:
        for row in batch.to_pylist():
            words = np.frombuffer(row["words"], "<u8")
            ids = unpack(words, np.array(row["offsets"]), np.array(row["n_raw"]), row["n_ids"])
            sizes = np.array(row["doc_tokens"], np.int64)
            starts = np.cumsum(sizes) - sizes
            cut = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.astype(np.int64)))
            columns = [pa.array([row["shard"]] * len(sizes), pa.int32()), pa.array(starts + row["first_id"]), pa.array(row["doc_ids"], pa.int64()), pa.array(sizes), cut]
            yield pa.RecordBatch.from_arrays(columns, names)


def read_token_files(spark, folder: str) -> DataFrame:
    """One row a document: ``shard``, ``inside`` (ids of its shard before it), ``doc_id``, ``n_tokens``, ``ids``."""
    files = spark.read.schema(SCHEMA + ", shard int").parquet(folder)
    return files.mapInArrow(_documents, "shard int, inside long, doc_id long, n_tokens long, ids array<long>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["shard", "inside", "doc_id", "n_tokens", "ids_crc32"]
    for documents in _documents(batches):
        ids = documents.column("ids")
        flat, cuts = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*documents.columns[:4], pa.array(crc, pa.int64())], names)


def digest(spark, folder: str) -> DataFrame:
    """Read token files back: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    files = spark.read.schema(SCHEMA + ", shard int").parquet(folder)
    sizes = files.select("shard", "n_ids")
    rows = files.mapInArrow(_digests, "shard int, inside long, doc_id long, n_tokens long, ids_crc32 long")
    totals = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    starts = support.with_offsets(support.staged(totals, "shards"), "shard", "n_ids", "shard_start", F.lit(0))
    found = rows.join(starts.select("shard", "shard_start"), "shard")
    return found.select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return ``digest`` of them."""
    spark = docs.sparkSession
    folder = shared.new_folder(spark, "token_ids")
    write_token_files(docs, folder, tokenizer)
    return digest(spark, folder)
