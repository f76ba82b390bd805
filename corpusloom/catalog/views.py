"""The provided tables in the shapes the operators work on. ``oracle.py`` defines the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import entities as en
from corpusloom.functions import sentences as st
from corpusloom.functions import text as tx
from corpusloom.functions.vectors import hashed_counts
from corpusloom.operators import ranking as rk
from corpusloom.operators import sentences as so
from corpusloom.plans import corpus
from corpusloom.shared import computed_once, cut_lineage

#: Texts to be cleaned where headlines are not asked for.
BODY = ("articles", "summary")
RAW_NAMES = ("newspaper_name", "published_date", "headline", "article_text", "human_summary", "news_category")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "html")


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw articles. The headline is the first line; the words of eight or more letters act as summary."""
    doc = F.col("doc_id")
    day = F.date_add(F.lit("2010-01-01").cast("date"), (doc % 4000).cast("int"))
    long_words = F.filter(F.split(tx.collapse_space(F.col("text")), " "), lambda w: F.length(w) >= 8)
    return documents(spark, sf_dir).select(
        "doc_id",
        F.col("source").alias("newspaper_name"),
        F.when(doc % 11 == 0, "unknown").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("published_date"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("headline"),
        F.col("text").alias("article_text"),
        F.array_join(long_words, " ").alias("human_summary"),
        F.when(doc % 17 != 0, F.col("lang")).alias("news_category"),
    )


def standard_rows(spark: SparkSession, sf_dir: str, texts: tuple[str, ...]) -> DataFrame:
    """All raw rows with standard names, cleaned ``texts`` and dates."""
    return corpus.standardized(raw_corpus(spark, sf_dir), texts)


def docs_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.clean_corpus(raw_corpus(spark, sf_dir))


def docs_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean corpus without its texts, computed once, for queries that read it several times."""
    return cut_lineage(docs_clean(spark, sf_dir).drop("headline", "articles_clean", "summary_clean"))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, text)`` of every document with its cleaned text."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    return computed_once(docs, {"text": tx.clean_text(F.col("text"))})


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole cleaned documents as sources; their first two thirds as reference, the last two as generated."""
    words = computed_once(cleaned(spark, sf_dir), {"w": tx.tokens(F.col("text"))})
    third = F.floor(F.size("w") / 3).cast("int")
    kept = F.size("w") - third
    return words.select(
        F.col("doc_id").alias("pair_id"),
        F.col("text").alias("source"),
        F.array_join(F.slice("w", third + 1, kept), " ").alias("generated"),
        F.array_join(F.slice("w", F.lit(1), kept), " ").alias("reference"),
    )


def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn as source, the assistant's next turn as generated text."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn", tx.clean_text(F.col("text")).alias("source"))
    reply = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), tx.clean_text(F.col("text")).alias("generated")
    )
    both = user.join(reply, ["conv_id", "turn"])
    return both.select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), "source", "generated")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalized words of the benchmark texts, and pairs of them in the documents; the label follows from the length."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(en.mentions(F.col("text"), en.WORD_PATTERN)).alias("entity"))
    pair = f"{en.WORD_PATTERN} {en.WORD_PATTERN}"
    names = documents(spark, sf_dir).select(F.explode(en.mentions(F.col("text"), pair)).alias("entity"))
    labels = F.array(*[F.lit(label) for label in en.ALL_LABELS])
    return cut_lineage(words.union(names).distinct()).select("entity", F.get(labels, F.length("entity") % len(en.ALL_LABELS)).alias("label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as graphs, one for each label, in the order of their ids; every seventh node of a graph shares an entity."""
    rows = table(spark, sf_dir, "embeddings").withColumn("_bucket", F.floor(F.col("vec_id") / 4096))
    return rk.add_rank(rows, ["vec_id"], "_bucket", ("label",)).select(
        F.col("label").cast("bigint").alias("cluster_id"),
        (F.col("rank") - 1).alias("pos"),
        F.col("embedding").alias("vec"),
        F.array((F.col("vec_id") % 7).cast("string")).alias("entities"),
    )


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(vec_id / 20).alias("pair_id"), (vec_id % 2).alias("side"), F.floor(vec_id % 20 / 2).alias("pos"), F.col("embedding").alias("vec")
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 10)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), scaled.alias("logits"))


def layer_weights(n_in: int, n_out: int) -> tuple[list[list[float]], list[float]]:
    """Weights of a test layer, W[j][k] = ((31 k + 17 j) % 13 - 6) / 10, a[k] = (7 k % 5 - 2) / 10."""
    weight = [[((31 * k + 17 * j) % 13 - 6) / 10 for k in range(n_out)] for j in range(n_in)]
    return weight, [((7 * k) % 5 - 2) / 10 for k in range(2 * n_out)]


def cluster_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents per cluster."""
    return cleaned(spark, sf_dir).select(
        F.floor(F.col("doc_id") / 3).alias("cluster_id"), (F.col("doc_id") % 3).alias("doc_pos"), "text"
    )


def with_features(rows: DataFrame) -> DataFrame:
    """Add bag-of-words vectors and capitalized words as entities to sentence rows."""
    return rows.select(
        "*",
        hashed_counts(F.split("sentence", " ")).alias("vec"),
        en.mentions(F.col("sentence"), "[A-Z][a-z]{3,}").alias("entities"),
    )


def cluster_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of document clusters with their features."""
    return with_features(so.cluster_sentences(cluster_docs(spark, sf_dir), "cluster_id", "doc_pos", "text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def latency_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_type").alias("model"),
        (F.col("value") / 100).alias("latency"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type as steps of a run in time order, one hundred steps per epoch; log(1 + value) is the loss.

    Ranges of (run, time, id) keep tasks even, whether one run or one moment holds most events.
    """
    rows = events(spark, sf_dir).select(F.col("event_type").alias("run"), "ts", "event_id", F.log1p("value").alias("loss"))
    ranked = rk.add_rank(rk.range_part(rows, ["run", "ts", "event_id"], "_part"), ["ts", "event_id"], "_part", ("run",))
    return ranked.select(
        "run", F.col("rank").alias("step"), (F.floor((F.col("rank") - 1) / 100) + 1).alias("epoch"), "loss"
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """DOUBLE columns to ``digits`` places, INT columns widened, so that results compare across engines."""

    def fit(name: str, kind: str) -> Column:
        if kind in ("double", "float"):
            return F.round(F.col(name).cast("double"), digits).alias(name)
        if kind in ("int", "smallint", "tinyint") or kind.startswith("decimal"):
            return F.col(name).cast("bigint").alias(name)
        return F.col(name)

    return df.select(*[fit(name, kind) for name, kind in df.dtypes])


def joined_arrays(df: DataFrame, *columns: str, separator: str = " ") -> DataFrame:
    """Array columns (also of arrays) as text."""

    def join(c: str) -> Column:
        value = F.flatten(c) if dict(df.dtypes)[c].startswith("array<array") else F.col(c)
        return F.array_join(F.transform(value, lambda x: x.cast("string")), separator)

    return df.withColumns({c: join(c) for c in columns})
