"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of (source, lang, topic). The cells' token shares are raked: scaled to the target shares of
the sources, then of the languages, then of the topics, again and again until all three hold. A document is drawn with
the ratio of its cell's raked to its real share, scaled so that a stated share of all tokens is kept, however large the input
and however rare its rarest cell. What is too rare for its target share is kept whole, and the others share the rest of the
budget as their targets say. Texts are only read; what is shuffled is one row a cell and task.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import support

DIMENSIONS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
#: What a text must hold to count as one of these topics, tried in this order.
TOPICS = {
    "license": r"(?i)licen[sc]e|all rights reserved|copyright",
    "contact": r"[A-Za-z0-9._-]@[A-Za-z0-9-]+\.[A-Za-z]|[0-9]{3}[ .-][0-9]{3}",
    "table": r" \| ",
    "numbers": r"[0-9]",
}
#: Target shares go with the token shares to this power: 1 keeps them, 0 makes all values equal.
TEMPER = {"source": 0.8, "lang": 0.9, "topic": 0.9}
TOLERANCE = 1e-12
#: Sweeps over the three dimensions at most; targets that contradict each other never agree, and a warning says how far they are off.
SWEEPS = 60
SEED = 17
#: Share of all tokens that the drawn documents hold.
KEEP = 0.6
#: Raking with upper bounds: factors and overshoot of a cell stay below this, so that no product leaves the range of doubles.
BOUND = 1e12


def _warned(off: float, tolerance: float) -> None:
    if off > tolerance:
        warnings.warn(f"raking ended with a target share missed by {off:.3g}", RuntimeWarning, stacklevel=3)


def topic_of(text: Column) -> Column:
    """The first topic whose pattern occurs in the whole text, else "general"."""
    found = F.lit("general")
    for topic, pattern in reversed(TOPICS.items()):
        found = F.when(text.rlike(pattern), F.lit(topic)).otherwise(found)
    return found


def tokens_of(text: Column) -> Column:
    """Words of a text, and one for its end, so that no document weighs nothing."""
    return F.regexp_count(text, F.lit(WORD)).cast("long") + 1


def _measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    plain = [F.coalesce(name, F.lit("")).alias(name) for name in ("source", "lang")]
    number = draw(F.col("doc_id").try_cast("long"), seed, content_of("text", "source")).alias("number")
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), *plain, topic_of(text).alias("topic"), tokens_of(text).alias("n_tokens"), number)


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares (``value``, ``share``) of a dimension: its token shares to a power, adding up to 1."""
    tokens = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("part"))
    whole = tokens.agg(F.sum("part").alias("whole"))
    return tokens.join(F.broadcast(whole)).select("value", (F.col("part") / F.col("whole")).alias("share"))


def _level(shares: DataFrame, keep: float) -> float:
    """The scale at which min(``most``, scale * ``share``) adds up to ``keep``; each round fills at least one more value."""
    scale = keep
    while True:
        full = F.lit(scale) * F.col("share") >= F.col("most")
        filled, rest = shares.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("share")))).first()
        higher = (keep - (filled or 0.0)) / rest if rest else scale
        if higher <= scale * (1 + 1e-12):
            return scale
        scale = higher


def _bounded_factor() -> Column:
    """Moves cells of a value, each up to its ``most``, towards ``share``: a Newton step on a sum that is concave in the factor.

    Cells below their bound make up ``free``, the others ``full``; ``total`` is the sum without bounds.
    """
    share, free, full = F.coalesce("share", F.lit(0.0)), F.col("free"), F.col("full")
    step = F.when(free > 0, (share - full) / free)
    up, down = F.coalesce(step, F.lit(1.0)), F.greatest(step, share / F.col("total"))
    moved = F.when(full + free <= share, up).otherwise(down)
    return F.when((share > 0) & (F.col("total") > 0), F.least(moved, F.lit(BOUND))).otherwise(0.0)


def rake_within(cells: DataFrame, targets: dict[str, DataFrame], keep: float, tolerance: float = TOLERANCE, sweeps: int = SWEEPS) -> DataFrame:
    """Add ``most`` and ``weight`` to ``cells``: each cell's share of all tokens, and the part of it that is kept.

    Weights add up to ``keep``, or to all tokens that have targets if these are fewer. A value whose target share of the
    kept tokens is more than it has is kept whole, the others of its dimension share the rest by their targets, and no
    cell exceeds its ``most``; within these bounds weights stay as close to the real shares as raking leaves them.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    fitted = cells.withColumn("most", F.col("tokens") / F.lit(float(total)))
    for dimension, target in targets.items():
        named = target.where("share > 0").select(F.col("value").alias(dimension), F.lit(True).alias(f"_{dimension}"))
        fitted = fitted.join(named, dimension, "left")
    live = F.expr(" and ".join(f"_{dimension} is not null" for dimension in targets))
    fitted = fitted.withColumn("weight", F.when(live, F.col("most")).otherwise(0.0)).drop(*[f"_{d}" for d in targets])
    fitted = support.staged(fitted, "cells")
    compact = support.small(fitted)

    def held(table: DataFrame, name: str) -> DataFrame:
        table = support.staged(table, name)
        return table.coalesce(1) if compact else table

    fitted = fitted.coalesce(1) if compact else fitted
    budget = min(keep, fitted.agg(F.sum("weight")).first()[0] or 0.0)
    wanted = {}
    for dimension, target in targets.items():
        there = fitted.where("weight > 0").groupBy(dimension).agg(F.sum("most").alias("most"))
        named = target.select(F.col("value").alias(dimension), F.col("share").cast("double").alias("share"))
        shares = held(there.join(named.coalesce(1) if compact else named, dimension), "shares")
        whole = shares.agg(F.sum("share")).first()[0] or 1.0
        shares = shares.withColumn("share", F.col("share") / F.lit(whole))
        level = _level(shares, budget)
        wanted[dimension] = held(shares.select(dimension, F.least("most", F.lit(level) * F.col("share")).alias("share")), "targets")
    names = fitted.columns
    kept, open_ = F.least("weight", "most"), F.col("weight") < F.col("most")
    sums_of = {"free": F.sum(F.when(open_, F.col("weight"))), "full": F.sum(F.when(~open_, F.col("most"))), "total": F.sum("weight")}
    if compact:
        # One partition: a value's sums are windows in it and its share is a column, so a sweep is one task, without broadcasts or shuffles,
        # each of which would be a job and some threads of the driver.
        fitted = fitted.dropna(subset=list(targets))
        for dimension, shares in wanted.items():
            fitted = fitted.join(shares.withColumnRenamed("share", f"_share_{dimension}"), dimension, "left")
        fitted = held(fitted, "bounded")
    missed = 0.0
    for sweep in range(1, sweeps + 1):
        for dimension in targets:
            if compact:
                group = Window.partitionBy(dimension)
                summed = fitted.withColumns({"share": F.col(f"_share_{dimension}")} | {name: F.coalesce(total.over(group), F.lit(0.0)) for name, total in sums_of.items()})
                fitted = summed.withColumn("factor", _bounded_factor()).drop("share", *sums_of)
            else:
                sums = fitted.groupBy(dimension).agg(*[F.coalesce(total, F.lit(0.0)).alias(name) for name, total in sums_of.items()])
                factor = sums.join(wanted[dimension], dimension, "left").select(dimension, _bounded_factor().alias("factor"))
                fitted = fitted.join(factor, dimension)
            moved = F.least(F.col("weight") * F.col("factor"), F.col("most") * F.lit(BOUND))
            fitted = fitted.withColumn("weight", moved).drop("factor")
        if sweep % 3 and sweep < sweeps:
            # Windows follow each other; joins would double the plan with each dimension.
            fitted = fitted if compact else held(fitted, "raked")
            continue
        fitted = held(fitted, "raked")
        if compact:
            sums = fitted.select(*[F.abs(F.sum(kept).over(Window.partitionBy(d)) - F.col(f"_share_{d}")).alias(d) for d in targets])
            off = [sums.agg(F.greatest(*[F.coalesce(F.max(d), F.lit(0.0)) for d in targets], F.lit(0.0)).alias("off"))]
        else:
            off = [
                fitted.groupBy(d).agg(F.sum(kept).alias("held")).join(wanted[d], d).agg(F.max(F.abs(F.col("held") - F.col("share"))).alias("off"))
                for d in targets
            ]
        worst = off[0]
        for more in off[1:]:
            worst = worst.union(more)
        missed = worst.agg(F.max("off")).first()[0] or 0
        if missed <= tolerance:
            break
    _warned(missed, tolerance)
    return fitted.withColumn("weight", kept).select(*names)


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, sweeps: int = SWEEPS) -> DataFrame:
    """Add ``weight`` to ``cells`` (``tokens``, a column a dimension): shares whose sums by each dimension are its target shares.

    ``targets``: for each dimension ``value`` and ``share``; a value that is not named gets weight 0, shares of values without
    tokens are dealt over the others. A sweep is one job; its result is staged, and only the largest deviation comes back.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    fitted = support.staged(cells.withColumn("weight", F.col("tokens") / F.lit(float(total))), "cells")
    compact = support.small(fitted)

    def held(table: DataFrame, name: str) -> DataFrame:
        """Staged. A few MB of cells are one partition, in which sums and joins need no shuffle; more stay spread."""
        table = support.staged(table, name)
        return table.coalesce(1) if compact else table

    fitted = fitted.coalesce(1) if compact else fitted
    wanted = {}
    for dimension, target in targets.items():
        live = target.coalesce(1) if compact else target
        live = live.select(F.col("value").alias(dimension), F.col("share").cast("double").alias("share")).join(fitted.select(dimension).distinct(), dimension, "left_semi")
        whole = live.agg(F.sum("share").alias("whole"))
        wanted[dimension] = held(live.join(F.broadcast(whole)).select(dimension, (F.col("share") / F.col("whole")).alias("share")), "targets")
    missed = 0.0
    for sweep in range(1, sweeps + 1):
        for dimension in targets:
            sums = fitted.groupBy(dimension).agg(F.sum("weight").alias("held"))
            factor = sums.join(wanted[dimension], dimension, "left").select(dimension, F.when(F.col("held") > 0, F.coalesce("share", F.lit(0.0)) / F.col("held")).otherwise(0.0).alias("factor"))
            fitted = fitted.join(factor, dimension).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        fitted = held(fitted, "raked")
        if sweep % 3 and sweep < sweeps:
            continue
        off = [
            fitted.groupBy(d).agg(F.sum("weight").alias("held")).join(wanted[d], d).agg(F.max(F.abs(F.col("held") - F.col("share"))).alias("off"))
            for d in targets
        ]
        worst = off[0]
        for more in off[1:]:
            worst = worst.union(more)
        missed = worst.agg(F.max("off")).first()[0] or 0
        if missed <= tolerance:
            break
    _warned(missed, tolerance)
    return fitted


def cell_probabilities(measured: DataFrame, targets: dict[str, DataFrame | float] | None = None, rate: float = 1.0, keep: float | None = KEEP) -> DataFrame:
    """One row a cell: ``source``, ``lang``, ``topic``, ``probability`` of its documents. A target is a table or a power.

    With ``keep``, the drawn documents hold that share of all tokens (``rate`` times it, on average). Without, the largest
    ratio gets ``rate``, and so the rarest cell sets what is kept of the others.
    """
    cells = support.staged(measured.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "counted")
    cells = cells.coalesce(1) if support.small(cells) else cells
    chosen = {**TEMPER, **(targets or {})}
    tables = {d: t if isinstance(t, DataFrame) else tempered(cells, d, t) for d, t in chosen.items()}
    if keep is not None:
        fitted = rake_within(cells, tables, keep)
        part = F.when(F.col("weight") >= F.col("most") * (1 - 1e-9), 1.0).otherwise(F.col("weight") / F.col("most"))
        return support.staged(fitted.select(*DIMENSIONS, (part * rate).alias("probability")), "probabilities")
    fitted = rake(cells, tables)
    ratio = F.col("weight") / F.col("tokens")
    largest = fitted.agg(F.max(ratio)).first()[0] or 1.0
    return support.staged(fitted.select(*DIMENSIONS, (ratio / F.lit(largest) * rate).alias("probability")), "probabilities")


def content_of(text: Column | str, source: Column | str) -> Column:
    """A hash of a whole text and its source, as text."""
    return F.hex(F.xxhash64(F.coalesce(text, F.lit("")), F.coalesce(source, F.lit(""))))


def draw(doc_id: Column, seed: int = SEED, content: Column | None = None) -> Column:
    """A number from 0 to 1 that depends on the id, the seed and, if given, the content alone, so a task that runs twice
    draws alike. With content, rows without id and different rows that share one draw apart."""
    parts = [doc_id.cast("string"), F.lit(str(seed))]
    if content is not None:
        parts = [F.coalesce(parts[0], F.lit("")), parts[1], content]
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**12))


def probabilities(docs: DataFrame, targets: dict[str, DataFrame | float] | None = None, rate: float = 1.0, seed: int = SEED, keep: float | None = KEEP) -> DataFrame:
    """Every document: ``doc_id``, ``source``, ``lang``, ``topic``, ``n_tokens``, ``probability``, ``kept``.

    Null sources, languages and texts count as empty ones, which are values like any other. The number a row draws depends
    on its ``doc_id``, text and source; only rows that are equal in all three share it. An empty table gives no rows.
    """
    measured = support.staged(_measured(docs, seed), "measured")
    cells = cell_probabilities(measured, targets, rate, keep)
    rows = support.with_lookup(measured, cells, list(DIMENSIONS), "inner")
    return rows.select("doc_id", *DIMENSIONS, "n_tokens", "probability", (F.col("number") < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, targets: dict[str, DataFrame | float] | None = None, rate: float = 1.0, seed: int = SEED, keep: float | None = KEEP) -> DataFrame:
    """The drawn rows of ``docs``, all columns."""
    cells = cell_probabilities(_measured(docs), targets, rate, keep).select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], F.col("probability").alias("_probability"))
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row")
    text = F.coalesce("text", F.lit(""))
    marked = docs.select(row, F.coalesce("source", F.lit("")).alias("_source"), F.coalesce("lang", F.lit("")).alias("_lang"), topic_of(text).alias("_topic"))
    joined = support.with_lookup(marked, cells, [f"_{d}" for d in DIMENSIONS], "inner")
    number = draw(F.col("_row.doc_id").try_cast("long"), seed, content_of("_row.text", "_row.source"))
    return joined.where(number < F.col("_probability")).select("_row.*")
