"""Mixture-controlled packing of documents into token sequences.

Every source is a queue of packets (documents, cut after each ``SEQUENCE`` tokens) in ``doc_id`` order. Deficit round-robin gives
each queue a quantum a round, its share of a window, and serves packets while the tokens granted so far cover them; what
is not used is carried to the next round. A packet is therefore served in round ceil(tokens of its queue up to its end /
quantum), which needs no step-by-step run: one running total over (source, doc_id) gives the rounds, another over
(round, source, place) the place of each packet in the output. So windows keep the target proportions to within a
packet a source, and deficits go over windows and partitions alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import support
from corpusloom.llm.token_ids import default_path, encoder

SEQUENCE = 1024
#: Tokens of a window of the mixture, of all sources together.
WINDOW = 64 * SEQUENCE
ENTRY = "start long, length long, sequence_id long, offset long"


def token_store(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Token ids of whole texts, once, in the shared folder: ``doc_id``, ``source``, ``n_tokens``, ``ids`` (little-endian
    integers of 2 bytes where all ids of the document fit, else 4) and ``row``, a unique number."""
    path = tokenizer or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in support.slices(batch, "text", support.BATCH_BYTES)):
            flat, sizes = encoder(path).batch(part.column("text"))
            found = np.split(flat, np.cumsum(sizes)[:-1])
            binary = [ids.astype("<u2").tobytes() if ids.max() < 65536 else ids.tobytes() for ids in found]
            columns = [part.column("doc_id"), part.column("source"), pa.array(sizes, pa.int64()), pa.array(binary, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    encoded = rows.mapInArrow(encode, "doc_id long, source string, n_tokens long, ids binary")
    return support.staged(encoded.withColumn("row", F.monotonically_increasing_id()), "tokens", frugal=True)


def served(queue: DataFrame, targets: DataFrame | None = None, window: int = WINDOW, sequence: int = SEQUENCE) -> DataFrame:
    """Where the parts of each document go: ``row`` and pieces (``start``, ``length``, ``sequence_id``, ``offset``).

    ``queue`` has ``row``, ``doc_id``, ``source``, ``n_tokens``. ``targets`` (``source``, ``share``) may name other proportions than those of the
    tokens themselves; a source it does not name keeps its own share. Whatever the targets, everything is packed: when a
    queue is empty, the others go on.
    """
    placed = support.running_totals(queue, ["source", "doc_id", "row"], "n_tokens")
    sources = support.staged(placed.groupBy("source").agg(F.min("before").alias("base"), F.sum("n_tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    share = F.col("tokens") / F.lit(float(total))
    if targets is not None:
        sources = support.staged(sources.join(targets.select("source", "share"), "source", "left"), "shares")
        share = F.coalesce("share", share)
    packets = support.with_lookup(placed, sources, ["source"], "inner").select(
        "row", "source", "n_tokens", (F.col("before") - F.col("base")).alias("first"), (share * window).alias("quantum"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(sequence).cast("long"))).alias("start"),
    )
    packets = packets.select("row", "source", "start", (F.col("first") + F.col("start")).alias("place"), F.least(F.lit(sequence), F.col("n_tokens") - F.col("start")).cast("long").alias("length"), "quantum")
    turn = F.ceil((F.col("place") + F.col("length")) / F.col("quantum"))
    packets = packets.select("row", "source", "start", "place", "length", turn.alias("round"))
    at = support.running_totals(packets, ["round", "source", "place"], "length")
    room = sequence - F.col("before") % sequence
    head = F.least("length", room)
    number = F.floor(F.col("before") / sequence)
    pieces = F.array(
        F.struct(F.col("start"), head.alias("length"), number.alias("sequence_id"), (F.col("before") % sequence).alias("offset")),
        F.struct((F.col("start") + head).alias("start"), (F.col("length") - head).alias("length"), (number + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")),
    ).cast(f"array<struct<{ENTRY.replace(' ', ':')}>>".replace(",:", ","))
    return at.select("row", F.inline(pieces)).where("length > 0")


def pack(docs: DataFrame, tokenizer: str | None = None, targets: DataFrame | None = None, window: int = WINDOW, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids`` (4 bytes each).

    A document is its ids and an end id, so null and empty texts have one token; null sources form one queue with empty
    ones; rows that share a ``doc_id`` are documents of their own. Only the last sequence has free room, to be padded to
    ``sequence``. An empty table gives no piece.
    """
    store = token_store(docs, tokenizer)
    pieces = served(store.select("row", "doc_id", "source", "n_tokens"), targets, window, sequence)
    by_row = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    cut = store.select("row", "doc_id", "n_tokens", "ids").join(by_row.hint("shuffle_hash"), "row")
    return cut.select("doc_id", "n_tokens", "ids", "pieces").mapInArrow(_cut, f"doc_id long, doc_tokens long, ids binary, {ENTRY}")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "doc_tokens", "ids", "start", "length", "sequence_id", "offset"]
    for batch in (part for batch in batches for part in support.slices(batch, "ids", support.BATCH_BYTES)):
        pieces = batch.column("pieces")
        sizes = np.diff(pieces.offsets.to_numpy())
        flat = pieces.flatten()
        start, length = flat.field("start").to_numpy(), flat.field("length").to_numpy()
        of, parts = np.repeat(np.arange(len(sizes)), sizes), []
        stored, tokens = batch.column("ids"), batch.column("n_tokens").to_numpy()
        last, ids = -1, np.empty(0, "<u4")
        for doc, a, n in zip(of.tolist(), start.tolist(), length.tolist(), strict=True):
            if doc != last:
                binary = stored[doc].as_py()
                last, ids = doc, np.frombuffer(binary, "<u2" if len(binary) == 2 * tokens[doc] else "<u4").astype("<u4")
            parts.append(ids[a : a + n].tobytes())
        rest = [flat.field(name) for name in names[3:]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), pa.array(tokens[of]), pa.array(parts, pa.binary()), *rest], names)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and its ids, four bytes each, in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.col("parts"), F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"))


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the crc32 of their ids instead of the ids."""
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")
