"""Exact ranks over a whole table without a window that spans it.

Rows are placed in buckets whose order follows the sort order. Row counts per bucket, a few thousand
numbers, give every bucket the rank at which it starts; ranks inside a bucket need only its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from corpusloom.shared import cut_lineage

HASH_DIGITS = 3
# Stands for the key of a position before the first row.
BEFORE_FIRST = Row(position=0)
RANGE_BUCKETS = 1024


def hash_key(id_col: Column, seed: int = 42) -> Column:
    """Seeded pseudo-random sort key of a row: the order a shuffle with that seed gives."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def hash_bucket(key: Column, digits: int = HASH_DIGITS) -> Column:
    """Bucket of a ``hash_key``: 16 ** digits buckets of equal expected size, whatever the ids are."""
    return F.substring(key, 1, digits)


def range_part(df: DataFrame, order_by: list[str], target: str) -> DataFrame:
    """Add a bucket that never falls along ``order_by``, of any types: the partition of a range shuffle.

    ``df`` should be narrow; the result is checkpointed, since another shuffle might draw other bounds.
    """
    return cut_lineage(df.repartitionByRange(*order_by).withColumn(target, F.spark_partition_id()))


def range_bucket(df: DataFrame, column: str, target: str, buckets: int = RANGE_BUCKETS) -> DataFrame:
    """Add the bucket of a column between quantiles of the data (one job that returns them).

    Bounds follow the data, so no stretch of values can crowd one bucket; only equal values must share.
    The bounds become constants of the plan, hence the same for every use of the result.
    """
    if not isinstance(df.schema[column].dataType, NumericType):
        return range_part(df, [column], target)
    probabilities = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(column, probabilities, 0.25 / buckets)))
    if not cuts:
        return df.withColumn(target, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    source = f"_{target}_value"
    with_value = df.withColumn(source, F.col(column).cast("double"))
    bucketed = Bucketizer(splits=splits, inputCol=source, outputCol=target, handleInvalid="keep").transform(with_value)
    return bucketed.withColumn(target, F.col(target).cast("int")).drop(source)


def bucket_offsets(df: DataFrame, bucket: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, bucket, n_rows, start, total)``: rows of a bucket, rows before it, rows of its group."""
    counts = df.groupBy(*keys, bucket).agg(F.count("*").alias("n_rows"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns(
        {
            "start": F.coalesce(F.sum("n_rows").over(before), F.lit(0)),
            "total": F.sum("n_rows").over(group),
        }
    )


def add_rank(df: DataFrame, order_by: list[str], bucket: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add ``rank`` (1 for the first row of a group) in the order of ``order_by``, which must be total.

    ``bucket`` must never fall along that order. The table of offsets has one row per bucket (and group). How it is joined is left
    to Spark, which knows its size when it has been made: a caller's buckets may be many.
    """
    offsets = bucket_offsets(df, bucket, keys).select(*keys, bucket, "start")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order_by)
    local = df.withColumn("_local", F.row_number().over(inside))
    return (
        local.join(offsets, [*keys, bucket])
        .withColumn("rank", (F.col("start") + F.col("_local")).cast("bigint"))
        .drop("start", "_local")
    )


def rank_keys(df: DataFrame, order_by: list[str], bucket: str, positions: Callable[[int], dict[str, int]]) -> dict[str, Row | None]:
    """Per name, the sort key of the row at a 1-based position.

    A position before the first row gives ``BEFORE_FIRST``, one behind the last row None.

    ``positions`` maps the row count to named positions. Two small jobs run at once: one counts rows per
    bucket, one ranks the buckets that hold a wanted position. What comes back is one key per name, to be
    used as a constant, so the rows themselves are later compared with it wherever they lie.
    """
    offsets = cut_lineage(bucket_offsets(df.select(*order_by, bucket), bucket))
    total = offsets.agg(F.max("total")).first()[0] or 0
    keys: dict[str, Row | None] = {name: BEFORE_FIRST if place < 1 else None for name, place in positions(total).items()}
    places = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).cast("bigint").alias("pos")) for n, p in positions(total).items()])
    targets = offsets.select(bucket, "n_rows", "start", F.inline(places))
    hits = targets.where((F.col("pos") > F.col("start")) & (F.col("pos") <= F.col("start") + F.col("n_rows")))
    hits = hits.select(bucket, "name", (F.col("pos") - F.col("start")).alias("_local"))
    inside = Window.partitionBy(bucket).orderBy(*order_by)
    needed = df.select(*order_by, bucket).join(F.broadcast(hits.select(bucket).distinct()), bucket, "left_semi")
    ranked = needed.withColumn("_local", F.row_number().over(inside).cast("bigint"))
    for row in ranked.join(F.broadcast(hits), [bucket, "_local"]).select("name", F.struct(*order_by).alias("key")).collect():
        keys[row.name] = row.key
    return keys


def not_after(order_by: list[str], key: Row | None) -> Column:
    """The row's sort key is at most ``key``, as ``rank_keys`` gives it, compared column by column."""
    if key is None or key is BEFORE_FIRST:
        return F.lit(key is None)
    name, rest = order_by[0], order_by[1:]
    cut = F.lit(key[name])
    if not rest:
        return F.col(name) <= cut
    return (F.col(name) < cut) | ((F.col(name) == cut) & not_after(rest, key))
