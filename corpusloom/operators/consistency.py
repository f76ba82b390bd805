"""Factual consistency of generated texts: entities, entailment, topics, verdicts.

Scores are columns on the table of pairs, so a full report is one pass without a join. Every score stays
on the row of its pair; a pair that a model could not score has NULL there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import entities as en
from corpusloom.functions import text as tx
from corpusloom.functions.vectors import softmax
from corpusloom.shared import computed_once, stored

# Thresholds of the verdict, pass marks and topic check.
GOOD_PRECISION, GOOD_ENTAILMENT, GOOD_TOPIC = 0.7, 0.5, 0.5
FAIR_PRECISION, FAIR_ENTAILMENT = 0.5, 0.3
MAX_HALLUCINATION = 0.2
OFF_TOPIC = 0.3
LIKELY = 0.5


def zip_pairs(sources: DataFrame, predictions: DataFrame, references: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """Join ``(id, source)``, ``(id, generated)`` and ``(id, reference)``; a text without partners is left out."""
    joined = sources.join(predictions, id_col).join(references, id_col)
    return joined.select(id_col, "source", F.trim("generated").alias("generated"), "reference")


def add_entities(pairs: DataFrame, pattern: str = en.NAME_PATTERN) -> DataFrame:
    """Add the entity set of each text as a sorted array."""
    return computed_once(
        pairs,
        {
            f"{side}_entities": en.mentions(F.col(side), pattern)
            for side in ("source", "generated", "reference")
            if side in pairs.columns
        },
    )


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(F.size(whole) == 0, F.lit(empty)).otherwise(F.size(part) / F.size(whole))


def add_entity_scores(with_entities: DataFrame) -> DataFrame:
    """Add precision, recall, F1 and the entities the source does not have.

    No generated entities: precision 1. No reference entities: recall 1.
    """
    gen, src, ref = (F.col(f"{side}_entities") for side in ("generated", "source", "reference"))
    scored = with_entities.withColumns(
        {
            "entity_precision": _share(F.array_intersect(gen, src), gen, 1.0),
            "entity_recall": _share(F.array_intersect(gen, ref), ref, 1.0),
            "n_entities": F.size(gen).cast("bigint"),
            "hallucinated": F.sort_array(F.array_except(gen, src)),
        }
    )
    p, r = F.col("entity_precision"), F.col("entity_recall")
    return scored.withColumns(
        {
            "entity_f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0),
            "n_hallucinated": F.size("hallucinated").cast("bigint"),
        }
    )


def hallucination_rate() -> Column:
    """Over all pairs together: hallucinated entities / generated entities."""
    return F.sum("n_hallucinated") / F.greatest(F.sum("n_entities"), F.lit(1))


def entity_report(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.avg("entity_precision").alias("precision"),
        F.avg("entity_recall").alias("recall"),
        F.avg("entity_f1").alias("f1"),
        F.sum("n_hallucinated").alias("n_hallucinated"),
        F.sum("n_entities").alias("n_entities"),
        hallucination_rate().alias("hallucination_rate"),
    )


def add_entailment(logits: DataFrame, column: str = "logits") -> DataFrame:
    """Add class probabilities from three logits in the order contradiction, entailment, neutral."""
    probabilities = computed_once(logits, {"_p": softmax(F.col(column))})
    return probabilities.select(
        *logits.columns, F.col("_p")[0].alias("contradiction"), F.col("_p")[1].alias("entailment"), F.col("_p")[2].alias("neutral")
    )


def entailment_report(scored: DataFrame) -> DataFrame:
    n = F.greatest(F.count("entailment"), F.lit(1))
    return scored.agg(
        F.coalesce(F.avg("entailment"), F.lit(0.0)).alias("avg_entailment"),
        F.coalesce(F.avg("contradiction"), F.lit(0.0)).alias("avg_contradiction"),
        F.count_if(F.col("entailment") > LIKELY).alias("n_entailed"),
        F.count_if(F.col("contradiction") > LIKELY).alias("n_contradicted"),
        (F.count_if(F.col("entailment") > LIKELY) * 100 / n).alias("pct_entailed"),
        (F.count_if(F.col("contradiction") > LIKELY) * 100 / n).alias("pct_contradicted"),
    )


def add_topic_overlap(pairs: DataFrame, stop_words: tuple[str, ...] = tx.STOP_WORDS) -> DataFrame:
    """Add the share of the generated keywords that the source has; 0 without generated keywords."""
    words = computed_once(
        pairs,
        {"_gen": tx.keywords(F.col("generated"), stop_words), "_src": tx.keywords(F.col("source"), stop_words)},
    )
    overlap = _share(F.array_intersect("_gen", "_src"), F.col("_gen"), 0.0)
    return words.withColumn("topic_overlap", overlap).drop("_gen", "_src")


def topic_report(scored: DataFrame) -> DataFrame:
    off = F.count_if(F.col("topic_overlap") < OFF_TOPIC)
    return scored.agg(
        F.avg("topic_overlap").alias("avg_overlap"),
        off.alias("n_off_topic"),
        (off * 100 / F.greatest(F.count("topic_overlap"), F.lit(1))).alias("pct_off_topic"),
    )


def worst_pairs(scored: DataFrame, k: int = 5, excerpt: int = 200, listed: int = 5) -> DataFrame:
    """The ``k`` pairs of lowest entity precision, ties by id, with short excerpts for reading."""
    return scored.orderBy("entity_precision", "pair_id").limit(k).select(
        "pair_id",
        "entity_precision",
        F.coalesce("entailment", F.lit(0.0)).alias("entailment"),
        "topic_overlap",
        F.slice("hallucinated", 1, listed).alias("hallucinated"),
        *[tx.excerpt(F.col(c), excerpt).alias(c) for c in ("source", "generated", "reference")],
    )


def verdict(precision: Column, entailment: Column, topic: Column) -> Column:
    """``GOOD``, ``FAIR`` or ``POOR``."""
    good = (precision > GOOD_PRECISION) & (entailment > GOOD_ENTAILMENT) & (topic > GOOD_TOPIC)
    fair = (precision > FAIR_PRECISION) & (entailment > FAIR_ENTAILMENT)
    return F.when(good, "GOOD").when(fair, "FAIR").otherwise("POOR")


def consistency_report(scored: DataFrame, model: str, samples: int = 30) -> DataFrame:
    """One nested row: entity, entailment and topic sections, verdict, pass marks and the first ``samples`` pairs.

    ``scored`` holds the columns of ``add_entity_scores``, ``add_topic_overlap`` and ``add_entailment``. All pairs are scored once: their
    scores are stored without texts, and the pairs to list are found by their ids, which reach the scan as a filter.
    """
    n = F.greatest(F.count("entailment"), F.lit(1))
    numbers = scored.select("pair_id", "entity_precision", "entity_recall", "entity_f1", "n_hallucinated", "n_entities", "entailment", "contradiction", "topic_overlap")
    if samples:
        numbers = stored(numbers, "scores")
        ids = [row.pair_id for row in numbers.select("pair_id").orderBy("pair_id").limit(samples).collect()]
        # Missing ids come first; then ids up to the last one listed.
        known = [x for x in ids if x is not None]
        scored = scored.where(F.isnull("pair_id") | (F.col("pair_id") <= F.lit(known[-1])) if known else F.isnull("pair_id"))
    sums = numbers.agg(
        F.count("*").alias("num_samples"),
        F.avg("entity_precision").alias("precision"),
        F.avg("entity_recall").alias("recall"),
        F.avg("entity_f1").alias("f1"),
        hallucination_rate().alias("rate"),
        F.coalesce(F.avg("entailment"), F.lit(0.0)).alias("entailment"),
        F.coalesce(F.avg("contradiction"), F.lit(0.0)).alias("contradiction"),
        (F.count_if(F.col("entailment") > LIKELY) * 100 / n).alias("pct_entailed"),
        (F.count_if(F.col("contradiction") > LIKELY) * 100 / n).alias("pct_contradicted"),
        F.avg("topic_overlap").alias("overlap"),
        (F.count_if(F.col("topic_overlap") < OFF_TOPIC) * 100 / F.greatest(F.count("*"), F.lit(1))).alias("pct_off_topic"),
    )
    listed = sample_table(scored, samples)
    listed = listed.agg(F.sort_array(F.collect_list(F.struct(*listed.columns))).alias("samples"))
    sums = sums.crossJoin(F.broadcast(listed))  # one row on either side

    def rounded(name: str, digits: int, alias: str) -> Column:
        return F.round(name, digits).alias(alias)

    p, e, t, h = (F.col(c) for c in ("precision", "entailment", "overlap", "rate"))
    return sums.select(
        F.lit(model).alias("model"),
        "num_samples",
        F.struct(
            rounded("precision", 4, "precision"), rounded("recall", 4, "recall"), rounded("f1", 4, "f1"),
            rounded("rate", 4, "hallucination_rate"),
        ).alias("entity_consistency"),
        F.struct(
            rounded("entailment", 4, "avg_entailment"), rounded("contradiction", 4, "avg_contradiction"),
            rounded("pct_entailed", 1, "pct_entailed"), rounded("pct_contradicted", 1, "pct_contradicted"),
        ).alias("nli_consistency"),
        F.struct(rounded("overlap", 4, "avg_overlap"), rounded("pct_off_topic", 1, "pct_off_topic")).alias("topic_consistency"),
        verdict(p, e, t).alias("verdict"),
        F.struct(
            (p > GOOD_PRECISION).alias("entity_precision"), (e > GOOD_ENTAILMENT).alias("entailment"),
            (t > GOOD_TOPIC).alias("topic_overlap"), (h < MAX_HALLUCINATION).alias("hallucination_rate"),
        ).alias("passes"),
        "samples",
    )


def sample_table(scored: DataFrame, first: int | None = None, excerpt: int = 500, listed: int = 5) -> DataFrame:
    """One row per pair for the samples file; ``first`` keeps that many, in id order, for a short report."""
    rows = scored if first is None else scored.orderBy("pair_id").limit(first)
    return rows.select(
        F.col("pair_id").alias("id"),
        tx.excerpt(F.col("source"), excerpt).alias("source_excerpt"),
        "reference",
        "generated",
        "entity_precision",
        F.slice("hallucinated", 1, listed).alias("hallucinated_entities"),
        "entailment",
        "topic_overlap",
    )
