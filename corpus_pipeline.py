"""A training corpus from ``documents``: classified, deduplicated, freed of secrets, mixed and packed.

Every stage takes what the stage before has kept, written as Parquet and read again, and all but the last return the columns
of ``documents``. Extra columns pass through; an empty table passes all stages as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import shared
from corpusloom.llm import byte_net, mixing, packing, secret_scan, simhash
from corpusloom.llm.support import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network takes for good ones; it learns from the labelled rows that are not held out."""
    net = byte_net.train(docs, table(spark, sf_dir, "labels"))
    plain = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), "text")
    return byte_net.scores(plain, net).where("score >= 0.5").select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id; groups as in the contract of operator 5."""
    return simhash.one_of_each(docs, words=3, distance=3)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; stretches of text that the rules take for secrets are replaced, and ``n_chars`` follows."""
    return secret_scan.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the raked probabilities of their source, language and topic."""
    return mixing.sample(docs)


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, each source in proportion."""
    return packing.digests(packing.pack(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("mixture_packing", mixture_packing),
]

#: SQL can express neither the network nor the tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = shared.new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
