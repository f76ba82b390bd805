"""Corpus statistics: lengths, counts, vocabulary, dates, histograms, box plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.quantiles import exact_quantiles
from corpusloom.shared import cut_lineage


def length_stats(df: DataFrame, columns: tuple[str, ...], approx: bool = False) -> DataFrame:
    """One row per column: count, mean, median, 99 % quantile, min, max, sample deviation.

    For integer counts such as tokens per text: ``percentile`` keeps one counter per distinct value and
    combines before the shuffle, so its state is bounded by the longest text. ``approx`` takes a sketch.
    Columns of arbitrary doubles belong to ``exact_quantiles``.
    """
    quantile = (lambda c, p: F.percentile_approx(c, p, 10_000)) if approx else F.percentile
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                quantile(F.col(c), F.lit(0.5)).cast("double").alias("median"),
                quantile(F.col(c), F.lit(0.99)).cast("double").alias("p99"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                F.stddev_samp(c).alias("std"),
            ).alias(c)
            for c in columns
        ]
    )
    return wide.select(F.inline(F.array(*columns)))


def compression_stats(df: DataFrame) -> DataFrame:
    """Mean of the per-row ratios beside the ratio of the means, which is a different number."""
    return df.agg(
        F.avg("compression_ratio").alias("mean_of_ratios"),
        (F.avg("article_token_count") / F.avg("summary_token_count")).alias("ratio_of_means"),
        F.count("compression_ratio").alias("n_valid"),
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per value and share of all rows (NULL rows count in the share's base), largest first.

    The counts are checkpointed, so ``df`` is read once although the total is needed beside them.
    """
    grouped = cut_lineage(df.groupBy(column).agg(F.count("*").alias("n_rows")))
    total = grouped.agg(F.sum("n_rows").alias("_total"))
    counts = (
        grouped.where(F.col(column).isNotNull())
        .crossJoin(F.broadcast(total))
        .select(column, "n_rows", (F.col("n_rows") * 100 / F.col("_total")).alias("percent"))
    )
    return counts if top is None else counts.orderBy(F.desc("n_rows"), column).limit(top)


def group_sizes(df: DataFrame, column: str) -> DataFrame:
    """Number of groups, mean/median/min/max size, smallest and largest group (first name on a tie)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("n_groups"),
        F.avg("n").alias("mean_size"),
        F.percentile("n", F.lit(0.5)).alias("median_size"),
        F.min("n").alias("min_size"),
        F.max("n").alias("max_size"),
        F.min_by(column, F.struct("n", column)).alias("min_name"),
        F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("max_name"),
    )


def token_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``(token, n)`` over lower-case whitespace tokens of collapsed text."""
    words = df.select(F.explode(tx.tokens(F.lower(F.col(text_col)))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, text_col: str) -> DataFrame:
    """Tokens, distinct tokens, type-token ratio (0 for an empty corpus)."""
    sums = token_counts(df, text_col).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_types")
    )
    return sums.withColumn("type_token_ratio", F.coalesce(F.try_divide("n_types", "n_tokens"), F.lit(0.0)))


def vocabulary_approx(df: DataFrame, text_col: str, rsd: float = 0.01) -> DataFrame:
    """As ``vocabulary`` with a sketched number of types: no shuffle of tokens."""
    words = df.select(F.explode(tx.tokens(F.lower(F.col(text_col)))).alias("token"))
    sums = words.agg(F.count("*").alias("n_tokens"), F.approx_count_distinct("token", rsd).alias("n_types"))
    return sums.withColumn("type_token_ratio", F.coalesce(F.try_divide("n_types", "n_tokens"), F.lit(0.0)))


def temporal_coverage(df: DataFrame, year: str = "year") -> DataFrame:
    return df.agg(
        F.min(year).cast("bigint").alias("first_year"),
        F.max(year).cast("bigint").alias("last_year"),
        (F.max(year) - F.min(year)).cast("bigint").alias("span"),
        F.count(year).alias("n_valid"),
        F.count("*").alias("n_rows"),
    )


def _missing(column: str, kind: str) -> Column:
    value = F.col(f"`{column}`")
    return value.isNull() | F.isnan(value) if kind in ("double", "float") else value.isNull()


def missing_values(df: DataFrame) -> DataFrame:
    """Per column: missing values (NULL, and NaN in floating columns) and their percentage to two decimals."""
    wide = df.agg(F.count("*").alias("_rows"), *[F.count_if(_missing(c, kind)).alias(c) for c, kind in df.dtypes])
    long = wide.unpivot(["_rows"], list(df.columns), "column", "n_missing")
    percent = F.round(F.try_divide(F.col("n_missing") * 100, F.col("_rows")), 2)
    return long.select("column", "n_missing", percent.alias("percent_missing"))


def schema_report(df: DataFrame) -> DataFrame:
    """Position, name, type and number of values of every column."""
    wide = df.agg(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("position"),
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.count(F.col(field.name)).alias("n_values"),
            ).alias(f"_{i}")
            for i, field in enumerate(df.schema.fields, 1)
        ]
    )
    return wide.select(F.inline(F.array(*wide.columns)))


def _bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Index of the equal-width bin; the last one is closed on the right.

    The quotient may land next to the right bin by rounding, so it is checked against the bin edges.
    """
    step = (high - low) / bins
    guess = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
    lower = low + guess * step
    upper = low + (guess + 1) * step
    return F.when(x < lower, guess - 1).when((x >= upper) & (guess < bins - 1), guess + 1).otherwise(guess)


def histogram(df: DataFrame, column: str, bins: int = 50, approx: bool = False) -> DataFrame:
    """``(bin, low, high, n, mean, median)``: every bin has a row, also an empty one.

    Mean and median of the column, the marks drawn into the plot, repeat on each row. NaN counts as missing. A constant column
    is given a range of one around its value. The range is one row that is joined to all, so ``df`` is read twice and should be
    cheap to read. The exact median counts and orders values while the plan is built; with ``approx`` it comes from a sketch
    in the pass of the range, off by at most one in ten thousand ranks, and no job runs before the result is asked for.
    """
    values = df.where(~_missing(column, dict(df.dtypes)[column])).select(F.col(column).cast("double").alias("x"))
    ends = [F.coalesce(F.min("x"), F.lit(0.0)).alias("_low"), F.coalesce(F.max("x"), F.lit(1.0)).alias("_high"), F.avg("x").alias("_mean")]
    span = values.agg(*ends, F.percentile_approx("x", 0.5, 10_000).alias("_median"))
    if not approx:
        exact = exact_quantiles(values, "x", {"_median": 0.5}).agg(F.max("_median").alias("_median"))
        span = span.drop("_median").crossJoin(F.broadcast(exact))
    around = F.when(F.col("_low") == F.col("_high"), 0.5).otherwise(0.0)
    span = F.broadcast(span.withColumns({"_low": F.col("_low") - around, "_high": F.col("_high") + around}))
    low, high = F.col("_low"), F.col("_high")
    counted = values.crossJoin(span).groupBy(_bin(F.col("x"), low, high, bins).alias("bin")).agg(F.count("*").alias("n"))
    width = (high - low) / bins
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(span)
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (low + F.col("bin") * width).alias("low"),
        (low + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.col("_mean").alias("mean"),
        F.col("_median").alias("median"),
    )


def below_quantile(df: DataFrame, column: str, p: float = 0.99) -> DataFrame:
    """Rows whose value is smaller than the column's own quantile; NULL rows go."""
    cut = exact_quantiles(df, column, {"cut": p}).first()
    return df.where(F.lit(False)) if cut is None else df.where(F.col(column) < F.lit(cut.cut))


def top_shares(df: DataFrame, column: str, top: int = 8) -> DataFrame:
    """Largest groups with their share among the groups shown."""
    largest = value_counts(df, column, top).select(column, "n_rows")
    shown = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))
    return largest.select(column, "n_rows", (F.col("n_rows") * 100 / shown).alias("percent_shown"))


def box_plot(df: DataFrame, group: str, column: str, top: int = 6) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 spreads of the box) and outliers of the largest groups.

    For integer counts (see ``length_stats``). The joined tables have at most ``top`` rows.
    """
    largest = value_counts(df, group, top).select(group)
    rows = df.select(group, F.col(column).alias("x")).join(F.broadcast(largest), group, "left_semi")
    quartiles = rows.groupBy(group).agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    box = quartiles.select(
        group, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3")
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    low, high = F.col("q1") - reach, F.col("q3") + reach
    x = F.col("x").cast("double")
    return (
        rows.join(F.broadcast(box), group)
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.count("x").alias("n"),
            F.min(F.when(x >= low, x)).alias("_low"),
            F.max(F.when(x <= high, x)).alias("_high"),
            F.count_if((x < low) | (x > high)).alias("n_outliers"),
        )
        .select(
            group, "n", "q1", "median", "q3",
            F.least("_low", "q1").alias("whisker_low"),
            F.greatest("_high", "q3").alias("whisker_high"),
            "n_outliers",
        )
    )


def length_grid(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Counts of two lengths over a grid: a scatter plot of every row, at any number of rows."""
    span = df.agg(*[end(c).cast("double").alias(f"_{name}_{i}") for i, c in enumerate((x, y)) for name, end in (("low", F.min), ("high", F.max))])

    def cell(c: str, i: int) -> Column:
        low, high = F.col(f"_low_{i}"), F.col(f"_high_{i}")
        return F.when(low.isNull() | (low == high), F.lit(0).cast("bigint")).otherwise(_bin(F.col(c).cast("double"), low, high, bins))

    cells = df.crossJoin(F.broadcast(span)).select(cell(x, 0).alias("x_bin"), cell(y, 1).alias("y_bin"))
    return cells.groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))


def corpus_report(df: DataFrame) -> DataFrame:
    """Headline numbers of a clean corpus in one pass."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.avg("article_token_count").alias("avg_article_tokens"),
        F.min("article_token_count").alias("min_article_tokens"),
        F.max("article_token_count").alias("max_article_tokens"),
        F.avg("summary_token_count").alias("avg_summary_tokens"),
        F.min("summary_token_count").alias("min_summary_tokens"),
        F.max("summary_token_count").alias("max_summary_tokens"),
        F.count_distinct("category").alias("n_categories"),
        F.count_distinct("source").alias("n_sources"),
    )
