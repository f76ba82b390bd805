"""Places for a user's own models. Each runs in Arrow batches inside tasks, loaded once per task.

A factory is a function without arguments that builds the model and returns a function on a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Batch = Callable[[pd.DataFrame], pd.DataFrame]


def _per_task(factory: Callable[[], Batch]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apply = factory()
        for batch in batches:
            yield apply(batch)

    return run


def extract_entities(texts: DataFrame, factory: Callable[[], Batch], id_type: str = "bigint") -> DataFrame:
    """``(id, entity, label)`` from a batch of ``(id, text)``."""
    return texts.mapInPandas(_per_task(factory), f"id {id_type}, entity string, label string")


def encode_sentences(sentences: DataFrame, factory: Callable[[], Batch]) -> DataFrame:
    """Add ``vec`` to ``(cluster_id, pos, sentence, ...)``."""
    schema = T.StructType([*sentences.schema.fields, T.StructField("vec", T.ArrayType(T.DoubleType()))])
    return sentences.mapInPandas(_per_task(factory), schema)


def score_pairs(pairs: DataFrame, factory: Callable[[], Batch]) -> DataFrame:
    """``(pair_id, logits)`` from a batch of ``(pair_id, source, generated)``; whole texts are passed."""
    needed = pairs.select("pair_id", "source", "generated")
    return needed.mapInPandas(_per_task(factory), "pair_id bigint, logits array<double>")


def generate_summaries(clusters: DataFrame, factory: Callable[[], Batch]) -> DataFrame:
    """``(cluster_id, generated, latency, n_tokens)`` from a batch of ``(cluster_id, sentences)``."""
    return clusters.mapInPandas(
        _per_task(factory), "cluster_id bigint, generated string, latency double, n_tokens bigint"
    )
