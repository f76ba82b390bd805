"""Steps that several operators share: staging in the shared folder, running totals over sorted rows, byte texts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import shared

#: Bytes that a table may have, counted over its rows, before it is shuffled instead of broadcast.
BROADCAST_BYTES = 4_000_000
#: Bytes of texts that a Python task works on at a time, whatever Spark's batches hold. Changes no result.
BATCH_BYTES = 4_000_000
#: Settings of a frugal write: its shuffle files go as soon as it has ended, and Arrow batches are bounded by bytes besides rows.
FRUGAL = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: Settings under which Spark broadcasts by bytes that it has counted, never by the size of files: narrow rows take some fifty times their files.
COUNTED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": str(BROADCAST_BYTES)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """``values`` hold for the plans that run inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def staged(df: DataFrame, name: str, frugal: bool = False) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared folder and read it back.

    Cuts the lineage at files that outlive any executor; a task that runs twice commits once. ``frugal`` is for
    plans that are run once: see ``FRUGAL``.
    """
    spark = df.sparkSession
    folder = shared.new_folder(spark, name)
    with settings(spark, FRUGAL if frugal else {}):
        df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only; a null text becomes the empty one."""
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if the rows of a staged or checkpointed ``df`` hold at most ``max_bytes`` by their own lengths."""

    def width(name: str, kind: str) -> Column:
        if kind == "string":
            return F.coalesce(F.octet_length(name), F.lit(0))
        return F.coalesce(F.size(name), F.lit(0)) * 48 if kind.startswith("array") else F.lit(8)

    total = df.agg(F.sum(sum((width(*column) for column in df.dtypes), F.lit(16)).cast("long"))).first()[0]
    return (total or 0) <= max_bytes


def with_lookup(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join to a staged ``lookup`` with unique keys: broadcast while its measured bytes allow it, else a shuffled
    join, whose hot partitions Spark splits."""
    return rows.join(F.broadcast(lookup) if small(lookup) else lookup.hint("merge"), on, how)


def bytes_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding them."""
    return pc.cast(column, pa.binary()).to_pylist()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words between ASCII white space of all texts, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    places = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    before = np.concatenate([[0], np.cumsum(real)])
    return words.filter(pa.array(real)), np.diff(before[places])


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces whose texts hold about ``most`` bytes; one longer text is a piece of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        start = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def running_totals(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` over all rows that come earlier in ``order``.

    Rows are dealt by range, summed up inside each partition, and moved up by the totals of the partitions before:
    the only thing gathered is one number a partition. ``order`` should be unique; rows that tie on it get places in
    an order that is fixed once the table is staged.
    """
    names = rows.columns

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            sizes = batch.column(names.index(value)).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes) + total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - sizes, pa.int64())], [*names, "_inside"])
            total = int(ends[-1]) if len(ends) else total

    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    summed = dealt.mapInArrow(local, f"{schema}, _inside long").withColumn("_part", F.spark_partition_id())
    summed = staged(summed, "running")
    return with_offsets(summed, "_part", value, "before", F.col("_inside")).drop("_inside", "_part")


def with_offsets(rows: DataFrame, part: str, value: str, name: str, inside: Column) -> DataFrame:
    """Add ``name``: ``inside`` plus the sum of ``value`` over all rows whose ``part`` number is smaller.

    ``rows`` is staged; the totals are one row a part.
    """
    from pyspark.sql import Window

    totals = rows.groupBy(part).agg(F.sum(value).alias("_total"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    return rows.join(offsets, part).withColumn(name, inside + F.col("_offset")).drop("_offset")
