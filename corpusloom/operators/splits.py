"""Seeded order, exact splits, positional slices and samples.

Rows are never moved to be split: small jobs find the sort keys at the cut positions, and a comparison with
these constants then labels or filters the rows where they lie.
"""

from __future__ import annotations

from collections.abc import Callable
from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import ranking as rk

SPLITS = ("train", "val", "test")


def _hashed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    keyed = df.withColumn("_key", rk.hash_key(F.col(id_col), seed))
    return keyed.withColumn("_bucket", rk.hash_bucket(F.col("_key")))


def shuffle_rank(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """``(id, rank)``: position of every row in the seeded order."""
    return rk.add_rank(_hashed(df.select(id_col), id_col, seed), ["_key", id_col], "_bucket").select(id_col, "rank")


def add_split(
    df: DataFrame, id_col: str, train_ratio: float = 0.8, val_ratio: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add ``split``: of n rows in seeded order floor(n * train) are train, up to floor(n * (train + val)) val."""
    order = ["_key", id_col]
    cuts = rk.rank_keys(
        _hashed(df.select(id_col), id_col, seed),
        order,
        "_bucket",
        lambda n: {"train": floor(n * train_ratio), "val": floor(n * (train_ratio + val_ratio))},
    )
    label = F.lit(SPLITS[2])
    for name in ("val", "train"):
        label = F.when(rk.not_after(order, cuts[name]), name).otherwise(label)
    return df.withColumn("_key", rk.hash_key(F.col(id_col), seed)).withColumn("split", label).drop("_key")


def split_report(df: DataFrame, means: tuple[str, ...] = ()) -> DataFrame:
    """Per split: rows, share of all rows, mean of the given columns."""
    per_split = df.groupBy("split").agg(
        F.count("*").alias("n_rows"), *[F.avg(c).alias(f"avg_{c}") for c in means]
    )
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))  # over one row per split
    return per_split.select("split", "n_rows", (F.col("n_rows") / total).alias("share"), *[f"avg_{c}" for c in means])


def _between_positions(df: DataFrame, id_col: str, positions: Callable[[int], dict[str, int]]) -> DataFrame:
    """Rows behind position ``before`` up to position ``last``; the filter reaches the scan as a range of ids."""
    narrow = rk.range_bucket(df.select(id_col), id_col, "_bucket")
    cuts = rk.rank_keys(narrow, [id_col], "_bucket", positions)
    if cuts["before"] is not rk.BEFORE_FIRST:
        df = df.where(~rk.not_after([id_col], cuts["before"]))
    return df if cuts["last"] is None else df.where(rk.not_after([id_col], cuts["last"]))


def head(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The first ``n`` rows in id order (all of them if there are fewer, none for 0). Ids may be numbers or texts."""
    return _between_positions(df, id_col, lambda total: {"before": 0, "last": n})


def position_slice(df: DataFrame, id_col: str, start_ratio: float, n: int | None = None) -> DataFrame:
    """``n`` rows (or all) from position floor(rows * start_ratio) on, in id order."""

    def positions(total: int) -> dict[str, int]:
        start = floor(total * start_ratio)
        return {"before": start, "last": total if n is None else start + n}

    return _between_positions(df, id_col, positions)


def sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn without replacement (all of them if there are fewer)."""
    order = ["_key", id_col]
    cut = rk.rank_keys(_hashed(df.select(id_col), id_col, seed), order, "_bucket", lambda total: {"last": n})["last"]
    return df.withColumn("_key", rk.hash_key(F.col(id_col), seed)).where(rk.not_after(order, cut)).drop("_key")


def batch_manifest(df: DataFrame, id_col: str, epochs: int, batch_size: int, accumulation: int = 1, seed: int = 42) -> DataFrame:
    """``(epoch, batch_id, step_id, pos, id)``: a fresh seeded order per epoch, cut into batches.

    ``step_id`` groups ``accumulation`` batches, the rows of one weight update.
    """
    per_epoch = df.select(F.col(id_col), F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    keyed = per_epoch.withColumn(
        "_key", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("epoch").cast("string"), F.col(id_col).cast("string")))
    ).withColumn("_bucket", rk.hash_bucket(F.col("_key")))
    ranked = rk.add_rank(keyed, ["_key", id_col], "_bucket", ("epoch",))
    batch = F.floor((F.col("rank") - 1) / F.lit(batch_size))
    return ranked.select(
        F.col("epoch").cast("bigint").alias("epoch"),
        batch.alias("batch_id"),
        F.floor(batch / F.lit(accumulation)).alias("step_id"),
        F.pmod(F.col("rank") - 1, F.lit(batch_size)).alias("pos"),
        id_col,
    )


def split_overlap(df: DataFrame, id_col: str, start_ratio: float = 0.9) -> DataFrame:
    """Per split, how many of its rows also lie in the positional evaluation slice."""
    labelled = add_split(df, id_col)
    narrow = rk.range_bucket(df.select(id_col), id_col, "_bucket")
    cut = rk.rank_keys(narrow, [id_col], "_bucket", lambda total: {"before": floor(total * start_ratio)})["before"]
    in_slice = ~rk.not_after([id_col], cut)
    return labelled.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_if(in_slice).alias("n_in_eval_slice"))
