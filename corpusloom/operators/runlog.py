"""Analytics of training logs and inference logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.quantiles import exact_quantiles

BLOCK = 4096


def _blocks(df: DataFrame, keys: list[str], order: str, block: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates of every block of ``block`` consecutive order values within a group."""
    return df.groupBy(*keys, F.floor(F.col(order) / block).alias("_block")).agg(
        *[c.alias(name) for name, c in aggregates.items()]
    )


def running_mean(df: DataFrame, keys: list[str], order: str, value: str, block: int = BLOCK) -> DataFrame:
    """Add ``running_mean`` of ``value`` over the rows of a group up to this one, in the order of an integer.

    A group is cut into blocks of the order column. Sums of whole blocks carry over, so no task sees more
    than one block of rows, however long the group.
    """
    per_block = _blocks(df, keys, order, block, {"_s": F.sum(value), "_n": F.count(value)})
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *keys, "_block",
        F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    rows = rows.withColumns({"_s1": F.sum(value).over(inside), "_n1": F.count(value).over(inside)})
    joined = rows.join(carried, [*keys, "_block"])
    total = F.col("_s0") + F.coalesce("_s1", F.lit(0.0))
    return joined.withColumn("running_mean", F.try_divide(total, F.col("_n0") + F.col("_n1"))).drop(
        "_block", "_s0", "_n0", "_s1", "_n1"
    )


def epoch_means(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, n_batches, avg_<value>)``; 0 where no batch has a value."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n_batches"), (F.coalesce(F.sum(value), F.lit(0.0)) / F.greatest(F.count(value), F.lit(1))).alias(f"avg_{value}")
    )


def best_so_far(df: DataFrame, keys: list[str], order: str, value: str, block: int = BLOCK) -> DataFrame:
    """Rows strictly below every earlier value of their group. NaN is never an improvement."""
    number = F.when(~F.isnan(value), F.col(value))
    per_block = _blocks(df, keys, order, block, {"_m": F.min(number)})
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(*keys, "_block", F.min("_m").over(earlier).alias("_m0"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_m1", F.min(number).over(inside))
    joined = rows.join(carried, [*keys, "_block"])
    previous = F.coalesce(F.least("_m0", "_m1"), F.lit(float("inf")))
    return joined.where(number < previous).drop("_block", "_m0", "_m1")


def periodic(df: DataFrame, step: str, every: int) -> DataFrame:
    """Rows at which a periodic checkpoint is due."""
    return df.where((F.col(step) > 0) & (F.col(step) % every == 0))


def loss_tail(reports: DataFrame, k: int = 5) -> DataFrame:
    """``(model, back, step, loss, is_nan)``: the last ``k`` entries of each report's loss log, last first."""
    ordered = F.sort_array("training.loss_log")
    last = F.slice(F.reverse(ordered), 1, k)
    return reports.select("model", F.posexplode(last).alias("back", "entry")).select(
        "model",
        (F.col("back") + 1).cast("bigint").alias("back"),
        "entry.step",
        F.nanvl("entry.loss", F.lit(None)).alias("loss"),
        F.isnan("entry.loss").alias("is_nan"),
    )


def flatten_benchmarks(reports: DataFrame) -> DataFrame:
    """One flat row per inference report."""
    return reports.select("model", "params_total", "model_type", "inference.*", "system.gpu", "system.peak_vram_gb")


def flatten_trainings(reports: DataFrame) -> DataFrame:
    """One flat row per training report, the loss log reduced to its length."""
    return reports.select(
        "model", "architecture", "training_strategy", "training.train_samples", "training.epochs", "training.total_steps",
        "training.training_time_sec", F.size("training.loss_log").cast("bigint").alias("n_losses"),
        "evaluation.*", "inference.*",
    )


def latency_stats(log: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, median and 95 % latency, samples and tokens per second, mean tokens per sample."""
    sums = log.groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        F.avg("latency").alias("mean_latency"),
        F.try_divide(F.lit(1.0), F.avg("latency")).alias("samples_per_sec"),
        F.coalesce(F.try_divide(F.sum("tokens").cast("double"), F.sum("latency")), F.lit(0.0)).alias("tokens_per_sec"),
        F.avg("tokens").alias("avg_tokens"),
    )
    cuts = exact_quantiles(log, "latency", {"median_latency": 0.5, "p95_latency": 0.95}, tuple(keys))
    return sums.join(cuts, keys, "left")


def leaderboard(scores: DataFrame, id_col: str, metrics: dict[str, bool]) -> DataFrame:
    """``(metric, <id>, value, place)`` from one row per model; ``metrics`` maps a column to "higher is better".

    Equal values share a place. A metric has as many rows as there are models.
    """
    long = scores.unpivot([id_col], list(metrics), "metric", "value").where(F.col("value").isNotNull())
    higher = [m for m, up in metrics.items() if up]
    signed = F.when(F.col("metric").isin(higher), -F.col("value")).otherwise(F.col("value"))
    order = Window.partitionBy("metric").orderBy("_signed")
    return long.withColumn("_signed", signed).withColumn("place", F.rank().over(order).cast("bigint")).drop("_signed")


def best_per_metric(board: DataFrame) -> DataFrame:
    return board.where("place = 1").drop("place")


# What must hold in a sound report, as SQL conditions over its flat columns.
REPORT_RULES = {
    "rouge2 <= rouge1": "rouge2 <= rouge1",
    "rougeL <= rouge1": "rougeL <= rouge1",
    "scores in [0, 1]": "rouge1 between 0 and 1 and rouge2 between 0 and 1 and rougeL between 0 and 1",
}


def check_reports(reports: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``(rule, n_rows, n_broken, n_unknown)`` per rule, from one pass."""
    wide = reports.agg(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.count("*").alias("n_rows"),
                F.count_if(~F.expr(condition)).alias("n_broken"),
                F.count_if(F.expr(condition).isNull()).alias("n_unknown"),
            ).alias(f"_{i}")
            for i, (name, condition) in enumerate(rules.items())
        ]
    )
    return wide.select(F.inline(F.array(*wide.columns)))
