"""Score reports of generated texts, and summaries of document clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import sentences as st
from corpusloom.functions import text as tx
from corpusloom.operators import consistency, graph, hooks, ngram_scores, stemming
from corpusloom.operators import sentences as so
from corpusloom.shared import cut_lineage, stored


def token_forms(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tokens that ROUGE and BLEU compare, from one reading of the texts: both forms are stored, and later steps read theirs."""
    kinds, sides = {"rouge": ngram_scores.rouge_tokens, "bleu": ngram_scores.bleu_tokens}, {"gen": "generated", "ref": "reference"}
    columns = [
        F.array_join(tokenizer(F.coalesce(F.col(text), F.lit(""))), " ").alias(f"{kind}_{side}") for kind, tokenizer in kinds.items() for side, text in sides.items()
    ]
    forms = stored(pairs.select("pair_id", *columns), "tokens")
    rouge, bleu = (forms.select("pair_id", *[tx.tokens(F.col(f"{kind}_{side}")).alias(side) for side in sides]) for kind in kinds)
    return rouge, bleu


def stemmed_tokens(pairs: DataFrame) -> DataFrame:
    """Token pairs with English stems; stems are made from the distinct tokens of the pairs."""
    return stemmed(ngram_scores.token_pairs(pairs))


def stemmed(tokens: DataFrame) -> DataFrame:
    """``(pair_id, gen, ref)`` with stems in place of tokens."""
    words = tokens.select(F.explode(F.array_union("gen", "ref")).alias("token"))
    return ngram_scores.stem_pairs(tokens, stemming.counted_stems(words), min_len=4)


def score_report(
    pairs: DataFrame,
    model: str,
    latency: DataFrame | None = None,
    stem: bool = True,
    vectors: DataFrame | None = None,
    scored: DataFrame | None = None,
) -> DataFrame:
    """One nested row: ROUGE-1, ROUGE-2, ROUGE-L and BLEU of ``(pair_id, generated, reference)``, and more sections.

    ``latency`` is ``(latency, tokens)`` per generated text, ``vectors`` holds token vectors (``greedy_vector_f1``), ``scored``
    the columns that ``consistency_report`` needs. The texts are read once: their tokens are stored. Every section is a single row, so putting them side by side costs nothing.
    """
    tokens, bleu_tokens = token_forms(pairs)
    tokens = stemmed(tokens) if stem else tokens
    overlap = ngram_scores.rouge_report(tokens, longest=True)  # one pass: stems are looked up once
    bleu = ngram_scores.corpus_bleu(bleu_tokens).select("score")
    row = overlap.crossJoin(F.broadcast(bleu))
    sections = [
        F.lit(model).alias("model"),
        F.col("n_pairs").alias("num_samples"),
        F.struct(
            *[F.round(c, 4).alias(c) for c in ("rouge1", "rouge2", "rougeL")], F.round("score", 2).alias("bleu")
        ).alias("scores"),
    ]
    if latency is not None:
        cost = latency.agg(
            F.avg("latency").alias("_mean"),
            F.coalesce(F.try_divide(F.sum("tokens").cast("double"), F.sum("latency")), F.lit(0.0)).alias("_rate"),
        )
        row = row.crossJoin(F.broadcast(cost))
        sections.append(
            F.struct(
                F.round("_mean", 4).alias("mean_latency_sec"), F.round("_rate", 1).alias("throughput_tokens_per_sec")
            ).alias("inference")
        )
    if vectors is not None:
        row = row.crossJoin(F.broadcast(ngram_scores.greedy_vector_f1(vectors).agg(F.avg("f1").alias("_vector_f1"))))
        sections.append(F.round("_vector_f1", 4).alias("bertscore_f1"))
    if scored is not None:
        parts = ("entity_consistency", "nli_consistency", "topic_consistency", "verdict")
        facts = consistency.consistency_report(scored, model, 0).select(F.struct(*parts).alias("factual_consistency"))
        row = row.crossJoin(F.broadcast(facts))
        sections.append(F.col("factual_consistency"))
    return row.select(*sections)


def cluster_inputs(docs: DataFrame, cluster_col: str, pos_col: str, text_col: str, slots: int = st.SLOTS) -> DataFrame:
    """``(cluster_id, n_sentences, packed)``: the slots of each cluster, the input of a generator."""
    rows = so.cluster_sentences(docs, cluster_col, pos_col, text_col, slots).withColumnRenamed(cluster_col, "cluster_id")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "sentence")))
    grouped = rows.groupBy("cluster_id").agg(F.transform(ordered, lambda s: s["sentence"]).alias("_sentences"))
    return grouped.select(
        "cluster_id", F.size("_sentences").cast("bigint").alias("n_sentences"), st.pack(F.col("_sentences"), slots).alias("packed")
    )


def summarize(
    docs: DataFrame,
    cluster_col: str,
    pos_col: str,
    text_col: str,
    add_features: Callable[[DataFrame], DataFrame] | None = None,
    generator: Callable | None = None,
    k: int = 3,
    slots: int | None = None,
) -> DataFrame:
    """Summaries of document clusters: by the user's ``generator`` (see ``hooks``), or by extraction.

    All sentences take part unless ``slots`` limits them; a generator's input always has slots.

    Extraction needs ``add_features``, which adds ``vec`` and ``entities`` to ``(cluster_id, pos,
    sentence)`` rows, and takes the ``k`` best connected sentences.
    """
    if generator is not None:
        inputs = cluster_inputs(docs, cluster_col, pos_col, text_col, slots or st.SLOTS)
        return hooks.generate_summaries(inputs.select("cluster_id", F.col("packed").alias("sentences")), generator)
    if add_features is None:
        raise ValueError("extraction needs add_features; abstraction needs generator")
    rows = so.cluster_sentences(docs, cluster_col, pos_col, text_col, slots).withColumnRenamed(cluster_col, "cluster_id")
    nodes = cut_lineage(add_features(rows))
    return graph.extract_summaries(nodes.select("cluster_id", "pos", "sentence"), graph.adjacency(nodes, slots=slots), k)
