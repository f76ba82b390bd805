"""The registered queries of the subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import byte_net, chat, hard_negatives, mixing, oracle, packing, periodic_runs, quality_rules, repeats, search, secret_scan, simhash, simple8b, unigram_counts
from corpusloom.llm import support
from corpusloom.llm.support import table


def op1_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(table(spark, sf_dir, "documents"))


def op2_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest probability is 1 and the draw is by id alone, as in the SQL; the pipeline does neither."""
    drawn = mixing.probabilities(table(spark, sf_dir, "documents"), keep=None)
    drawn = drawn.withColumn("kept", mixing.draw(F.col("doc_id")) < F.col("probability"))
    return drawn.withColumn("probability", F.round("probability", 6))


def op3_chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts look like control strings."""
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = support.staged(chat.format_conversations(turns.unionByName(probe)), "chat")
    return chat.digests(formatted)


def op4_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op5_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3)
    return found.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


def op6_byte_net_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_net.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


def op9_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 100 = 0"))


def op10_voted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.FEATURES[:5], "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op11_suffix_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(table(spark, sf_dir, "documents"), plant=True))


def op13_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in seven rows first moves to the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


QUERIES = {name: f for name, f in globals().items() if name.startswith("op")}
ORACLES = {
    "op2_raked_mixture": oracle.MIXING,
    "op3_chat_segments": oracle.CHAT,
    "op4_trigram_secrets": oracle.secrets(),
    "op9_bm25_top_k": oracle.SEARCH,
    "op11_suffix_tree_repeats": oracle.REPEATS,
    "op13_angular_negatives": oracle.NEGATIVES,
}
