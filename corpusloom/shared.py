"""Folders every executor can reach, and joins whose small side is checked before it is broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a table that is sent to all tasks.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000
#: Bytes of keys and values that a dictionary in every Python worker may hold; as a ``dict`` it takes there some four times as much.
DICTIONARY_BYTES = 24_000_000
SALTS = 16
#: Rows of an Arrow batch that are Python objects at one time.
ROWS = 128


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/corpusloom/{uuid.uuid4().hex}/{name}"


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add (or replace) columns that later filters use, without their expressions being run again there.

    Spark pushes a filter through a projection by copying the filtered expression, so a costly text
    expression would run once in the filter and once more in the projection. It does not push filters
    through a generator.
    """
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], made)


def row_by_row(*columns: pa.Array) -> Iterator[tuple]:
    """The rows of Arrow columns, few of them as Python objects at a time: what a worker needs goes with a batch's bytes, not with its objects."""
    for start in range(0, len(columns[0]), ROWS):
        yield from zip(*(column.slice(start, ROWS).to_pylist() for column in columns), strict=True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: computed once, and it survives the loss of executors.

    For narrow tables that several later steps read and that are dear to compute, such as ids and counts
    drawn from cleaned texts.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder as compressed Parquet and read again: for wide tables that several later steps read.

    Unlike a checkpoint, a later step reads only the columns it needs.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fits_broadcast(table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if ``table`` has at most ``max_rows`` rows that hold at most ``max_bytes``; reads no more than one row beyond that.

    Texts count with their bytes, however long; lists and records with those of their JSON."""

    def width(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(name), F.lit(0))
        return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) if "<" in kind else F.lit(8)

    total = sum((width(*column) for column in table.dtypes), F.lit(16)).cast("long")
    rows, size = table.limit(max_rows + 1).agg(F.count("*"), F.sum(total)).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def _entry_bytes(table: DataFrame) -> Column:
    key, value = table.columns[:2]
    return F.octet_length(F.col(key).cast("string")) + F.octet_length(F.col(value).cast("string")) + 16


def dictionary_bytes(table: DataFrame) -> int:
    """What the rows of a table ``(key, value...)`` count in a dictionary."""
    return table.agg(F.sum(_entry_bytes(table))).first()[0] or 0


def dictionary(table: DataFrame, max_bytes: int = DICTIONARY_BYTES) -> Broadcast[dict] | None:
    """A checkpointed two-column table as a dictionary in every task, or None if its rows hold more than ``max_bytes``.

    For tasks that look words up where they lie, instead of moving a row a word.
    """
    if dictionary_bytes(table) > max_bytes:
        return None
    return table.sparkSession.sparkContext.broadcast({row[0]: row[1] for row in table.collect()})


def common_part(table: DataFrame, order: str, max_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """The rows of a table ``(key, value, order)`` with the smallest ``order`` that a dictionary of ``max_bytes`` holds, long keys left out."""
    n, size = table.agg(F.count("*"), F.sum(_entry_bytes(table))).first()
    share = max_bytes / max(size or 0, 1)
    if not n or share < 0.01:
        return table.limit(0)
    short = table.where(F.octet_length(table.columns[0]) <= 64)
    if share >= 1:
        return short
    cut = short.approxQuantile(order, [share], share / 20)
    return short.where(F.col(order) < cut[0]) if cut else short


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    salt_by: Column,
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``rows`` to a lookup ``table`` with unique keys, whatever the size of the table.

    A table of at most ``max_rows`` rows, and of as many bytes as ``fits_broadcast`` allows, is broadcast. A larger one is shuffled, with the key salted:
    each lookup row is copied ``salts`` times and ``rows`` spread over the copies by ``salt_by``, so a
    key holding a third of all rows is handled by ``salts`` tasks. The table is checkpointed first, since
    counting its rows would otherwise compute it twice.
    """
    table = cut_lineage(table)
    if fits_broadcast(table, max_rows):
        return rows.join(F.broadcast(table), on, how)
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_rows.join(copies, [*on, "_salt"], how).drop("_salt")
