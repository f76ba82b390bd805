"""Exact quantiles with linear interpolation over any number of distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import ranking as rk
from corpusloom.shared import cut_lineage


def exact_quantiles(
    df: DataFrame, column: str, probabilities: dict[str, float], keys: tuple[str, ...] = ()
) -> DataFrame:
    """``(keys, name...)``: one column per named probability; NULL and NaN are left out.

    Spark's ``percentile`` holds every distinct value of a group in one task. Here equal values are
    counted first, the distinct values of a group are spread over buckets between quantiles of the whole
    column, and only the buckets that hold a wanted rank are ordered. ``df`` is read once: the counts are
    checkpointed, and all further steps read them.
    """
    values = df.select(*keys, F.col(column).cast("double").alias("_value")).where("_value is not null and not isnan(_value)")
    counts = cut_lineage(values.groupBy(*keys, "_value").agg(F.count("*").alias("_n")))
    distinct = rk.range_bucket(counts, "_value", "_bucket")
    totals = distinct.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_rows"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumns(
        {"_start": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_total": F.sum("_rows").over(group)}
    )
    places = F.array(
        *[
            F.struct(F.lit(name).alias("_name"), ((F.col("_total") - 1) * F.lit(float(p))).alias("_place"))
            for name, p in probabilities.items()
        ]
    )
    wanted = offsets.select(*keys, "_bucket", "_rows", "_start", F.inline(places))
    both = F.array(F.floor("_place"), F.ceil("_place"))
    ranks = wanted.select("*", F.posexplode(F.transform(both, lambda r: r + 1)).alias("_side", "_rank"))
    hits = ranks.where((F.col("_rank") > F.col("_start")) & (F.col("_rank") <= F.col("_start") + F.col("_rows")))
    hits = hits.select(*keys, "_bucket", "_name", "_place", "_side", (F.col("_rank") - F.col("_start")).alias("_local"))
    cells = hits.select(*keys, "_bucket").distinct()
    if not keys:
        cells, hits = F.broadcast(cells), F.broadcast(hits)
    upto = Window.partitionBy(*keys, "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    ordered = distinct.join(cells, [*keys, "_bucket"], "left_semi").withColumn("_upto", F.sum("_n").over(upto))
    inside = (F.col("_local") <= F.col("_upto")) & (F.col("_local") > F.col("_upto") - F.col("_n"))
    found = ordered.join(hits, [*keys, "_bucket"]).where(inside)
    pairs = found.groupBy(*keys, "_name").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_value"))).alias("_low"),
        F.max(F.when(F.col("_side") == 1, F.col("_value"))).alias("_high"),
        F.max("_place").alias("_place"),
    )
    share = F.col("_place") - F.floor("_place")
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * share
    return pairs.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, value)).alias(name) for name in probabilities]
    )
