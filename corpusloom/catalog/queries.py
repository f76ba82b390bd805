"""One query per operator over the provided tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import views as v
from corpusloom.functions import entities as en
from corpusloom.functions import sentences as st
from corpusloom.functions import text as tx
from corpusloom.operators import consistency, dense_graph, filters, graph, ngram_scores, profile, records, runlog, splits, standardize
from corpusloom.operators import sentences as so
from corpusloom.plans import evaluation
from corpusloom.shared import computed_once, cut_lineage, new_folder
from corpusloom.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the function's name (without a closing underscore), with numbers fit for comparison."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return v.rounded(function(spark, sf_dir))

    QUERIES[function.__name__.rstrip("_")] = run
    return function


# Sources and sinks


@query
def src_raw(spark, sf_dir):
    path = new_folder(spark, "raw_csv")
    writers.write_raw(v.raw_corpus(spark, sf_dir), path, "csv")
    return readers.read_raw(spark, path, "csv")


@query
def src_excel(spark, sf_dir):
    path = new_folder(spark, "raw_xlsx")
    writers.write_raw(v.raw_corpus(spark, sf_dir), path, "xlsx")
    return readers.read_raw(spark, path, "xlsx")


@query
def src_formats(spark, sf_dir):
    """The same raw table out of files of each format."""
    found = []
    for fmt in ("json", "parquet", "orc"):
        path = new_folder(spark, f"raw_{fmt}")
        writers.write_raw(v.raw_corpus(spark, sf_dir).drop("article_text"), path, fmt)
        found.append(readers.read_raw(spark, path, fmt).drop("article_text").withColumn("format", F.lit(fmt)))
    return reduce(DataFrame.unionByName, found)


@query
def bad_rows(spark, sf_dir):
    """JSON lines of the documents, some cut short and some with a text as their id, read back: what fits, and the quarantine."""
    path, quarantine = new_folder(spark, "lines"), new_folder(spark, "quarantine")
    doc = F.col("doc_id")
    line = F.to_json(F.struct(F.when(doc % 13 == 0, F.concat(F.lit("no "), doc)).otherwise(doc.cast("string")).alias("headline"), F.col("text").alias("article_text")))
    whole = F.concat(F.lit('{"doc_id": '), F.when(doc % 13 == 0, F.concat(F.lit('"no '), doc, F.lit('"'))).otherwise(doc.cast("string")), F.lit(", "), F.substr(line, F.lit(2)))
    cut = F.when(doc % 17 == 0, F.substr(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    v.documents(spark, sf_dir).select(cut.alias("value")).write.text(path)
    checked = readers.read_checked(spark, path, "json")
    writers.write_quarantine(checked, quarantine)
    number = F.regexp_extract(readers.BAD_RECORD, '"headline":"(?:no )?([0-9]+)"', 1).cast("long")
    bad = spark.read.json(quarantine, schema=f"{readers.BAD_RECORD} string, kind string")
    kept = readers.fitting(checked).select("doc_id", F.lit("fits").alias("state"), F.length("article_text").cast("long").alias("n_chars"))
    return kept.unionByName(bad.select(number.alias("doc_id"), F.lit("bad").alias("state"), F.length(readers.BAD_RECORD).cast("long").alias("n_chars")))


@query
def sink_roundtrip(spark, sf_dir):
    path = new_folder(spark, "corpus")
    writers.write_corpus(v.docs_clean(spark, sf_dir), path)
    back = readers.read_corpus(spark, path)
    return back.withColumn("date", F.col("date").cast("date").cast("string"))


@query
def sink_splits(spark, sf_dir):
    path = new_folder(spark, "splits")
    writers.write_splits(splits.add_split(v.documents(spark, sf_dir).select("doc_id", "source", "n_chars"), "doc_id"), path)
    return spark.read.parquet(path).select("doc_id", "source", "n_chars", "split")


def _scored_pairs(spark, sf_dir):
    """Every score of a pair on its row; entailment is NULL where no logits exist."""
    scored = consistency.add_topic_overlap(
        consistency.add_entity_scores(consistency.add_entities(v.pairs(spark, sf_dir), "[A-Z][a-z]{3,}"))
    )
    entailment = consistency.add_entailment(v.logits(spark, sf_dir)).select("pair_id", "entailment", "contradiction")
    return scored.join(entailment, "pair_id", "left")


@query
def eval_report(spark, sf_dir):
    path = new_folder(spark, "report")
    report = consistency.consistency_report(_scored_pairs(spark, sf_dir), "third-overlap")
    writers.write_report(report, path)
    back = readers.read_reports(spark, path, report.schema, multi_line=False)
    return back.select(
        "model", "num_samples", "entity_consistency.*", "nli_consistency.*", "topic_consistency.*", "verdict",
        *[F.col(f"passes.{c}").cast("string").alias(f"pass_{c}") for c in ("entity_precision", "entailment", "topic_overlap", "hallucination_rate")],
        F.array_join(F.transform("samples", lambda s: s["id"].cast("string")), " ").alias("sample_ids"),
    )


@query
def eval_samples(spark, sf_dir):
    path = new_folder(spark, "samples")
    samples = consistency.sample_table(_scored_pairs(spark, sf_dir))
    writers.write_samples(samples, path)
    back = spark.read.schema(samples.schema).json(path)
    return v.joined_arrays(back, "hallucinated_entities", separator="|")


def _benchmark_reports(spark, sf_dir):
    stats = runlog.latency_stats(v.latency_log(spark, sf_dir), ["model"])
    return stats.select(
        "model",
        (F.col("n_samples") * 1000).alias("params_total"),
        F.lit("~1").alias("params_m"),
        F.lit("seq2seq").alias("model_type"),
        F.struct(
            F.col("n_samples").alias("num_samples"),
            F.col("mean_latency").alias("mean_latency_sec"),
            F.col("median_latency").alias("median_latency_sec"),
            F.col("p95_latency").alias("p95_latency_sec"),
            F.col("samples_per_sec").alias("throughput_samples_per_sec"),
            F.col("tokens_per_sec").alias("throughput_tokens_per_sec"),
            F.col("avg_tokens").alias("avg_generated_tokens"),
        ).alias("inference"),
        F.struct(F.lit("none").alias("gpu"), F.lit(0.5).alias("peak_vram_gb"), F.lit(12.5).alias("ram_gb")).alias("system"),
    )


def _read_benchmarks(spark, sf_dir):
    path = new_folder(spark, "benchmarks")
    writers.write_samples(_benchmark_reports(spark, sf_dir), path)
    return readers.read_reports(spark, path, readers.BENCHMARK_REPORT_SCHEMA, multi_line=False)


@query
def reports_flatten(spark, sf_dir):
    return runlog.flatten_benchmarks(_read_benchmarks(spark, sf_dir))


# Projections and schema


def _messy_names(df: DataFrame) -> DataFrame:
    """Column names with the blanks and line breaks of hand-made sheets."""
    return df.toDF(*[f" {c[:4]}\n{c[4:]} " if c in v.RAW_NAMES else c for c in df.columns])


@query
def standardize_(spark, sf_dir):
    return standardize.standardize_names(_messy_names(v.raw_corpus(spark, sf_dir)))


@query
def clean_columns(spark, sf_dir):
    rows = standardize.add_clean_columns(standardize.standardize_names(v.raw_corpus(spark, sf_dir)))
    texts = standardize.strings_only(rows, ("source", "category"), null_label="nan")
    return standardize.select_existing(texts, ("doc_id", *standardize.CORPUS_COLUMNS, "headline_clean")).drop("date")


@query
def date_parse(spark, sf_dir):
    rows = standardize.standardize_names(v.raw_corpus(spark, sf_dir).select("doc_id", "published_date"))
    dated = rows.withColumn("text", F.col("date"))
    parsed = standardize.add_dates(dated)
    return parsed.select(
        "doc_id", F.col("date").cast("date").cast("string").alias("day"), "year",
        (F.col("text").isNotNull() & F.col("date").isNull()).cast("string").alias("is_bad"),
    )


@query
def compression(spark, sf_dir):
    return profile.compression_stats(v.docs_clean(spark, sf_dir))


@query
def token_counts(spark, sf_dir):
    return v.standard_rows(spark, sf_dir, v.BODY).select(
        "doc_id",
        tx.count_tokens(F.col("articles_clean"), collapsed=True).alias("article_tokens"),
        tx.count_tokens(F.col("summary_clean"), collapsed=True).alias("summary_tokens"),
        tx.count_tokens(F.col("articles")).alias("raw_tokens"),
    )


@query
def word_counts(spark, sf_dir):
    return v.documents(spark, sf_dir).select("doc_id", tx.count_words(F.col("text")).alias("n_words"))


# Text functions


@query
def html_strip(spark, sf_dir):
    return v.html_rows(spark, sf_dir).select("page_id", tx.clean_html(F.col("html")).alias("text"))


@query
def url_strip(spark, sf_dir):
    return v.html_rows(spark, sf_dir).select("page_id", tx.strip_urls(tx.collapse_space(F.col("html"))).alias("text"))


@query
def email_strip(spark, sf_dir):
    return v.documents(spark, sf_dir).select("doc_id", tx.strip_emails(tx.collapse_space(F.col("text"))).alias("text"))


@query
def clean_text(spark, sf_dir):
    return v.cleaned(spark, sf_dir).select("doc_id", "text", F.length("text").alias("n_chars"))


@query
def clean_pages(spark, sf_dir):
    return v.html_rows(spark, sf_dir).select("page_id", tx.clean_text(F.col("html")).alias("text"))


@query
def vocab(spark, sf_dir):
    rows = v.standard_rows(spark, sf_dir, v.BODY)
    texts = rows.select(F.explode(F.create_map(F.lit("articles"), "articles_clean", F.lit("summaries"), "summary_clean")).alias("part", "text"))
    words = texts.select("part", F.explode(tx.tokens(F.lower(F.col("text")))).alias("token"))
    counts = words.groupBy("part", "token").agg(F.count("*").alias("n"))
    return counts.groupBy("part").agg(
        F.sum("n").alias("n_tokens"), F.count("*").alias("n_types"), (F.count("*") / F.sum("n")).alias("type_token_ratio")
    )


@query
def vocab_whole(spark, sf_dir):
    return profile.vocabulary(v.cleaned(spark, sf_dir), "text")


@query
def vocab_tokens(spark, sf_dir):
    return profile.token_counts(v.cleaned(spark, sf_dir), "text")


@query
def vocab_approx(spark, sf_dir):
    return profile.vocabulary_approx(v.cleaned(spark, sf_dir), "text")


@query
def keywords(spark, sf_dir):
    rows = v.cleaned(spark, sf_dir).select("doc_id", tx.keywords(F.col("text")).alias("keywords"))
    return v.joined_arrays(rows.withColumn("n_keywords", F.size("keywords")), "keywords")


@query
def sentences(spark, sf_dir):
    return so.sentence_rows(v.cleaned(spark, sf_dir), "doc_id", "text")


@query
def sentences_topn(spark, sf_dir):
    return so.sentence_rows(v.cleaned(spark, sf_dir), "doc_id", "text", first=st.SLOTS)


@query
def pack_sentences(spark, sf_dir):
    return v.cleaned(spark, sf_dir).select("doc_id", st.pack(st.split_sentences(F.col("text"))).alias("packed"))


@query
def unpack_sentences(spark, sf_dir):
    packed = v.cleaned(spark, sf_dir).select("doc_id", st.pack(st.split_sentences(F.col("text"))).alias("packed"))
    return computed_once(packed, {"packed": F.col("packed")}).select(
        "doc_id",
        st.count_filled(F.col("packed")).alias("n_filled"),
        F.array_join(st.slot_mask(F.col("packed")), "").alias("mask"),
        st.packed_to_text(F.col("packed")).alias("text"),
    )


@query
def entities(spark, sf_dir):
    return so.entity_rows(v.cleaned(spark, sf_dir), "doc_id", "text", v.gazetteer(spark, sf_dir))


@query
def entities_typed(spark, sf_dir):
    docs = v.standard_rows(spark, sf_dir, ("articles",)).select(
        "doc_id", F.concat_ws(" ", F.col("date").cast("date").cast("string"), F.concat(F.lit("$"), F.length("articles_clean")), "articles_clean").alias("text")
    )
    return so.entity_rows(docs, "doc_id", "text", v.gazetteer(spark, sf_dir), en.ALL_LABELS)


@query
def entity_mentions(spark, sf_dir):
    return v.cleaned(spark, sf_dir).select("doc_id", F.explode(en.mentions(F.col("text"))).alias("entity"))


@query
def sft_records(spark, sf_dir):
    return records.prompt_records(v.docs_clean(spark, sf_dir), "doc_id", F.col("articles_clean"), F.col("summary_clean"))


@query
def cluster_concat(spark, sf_dir):
    return so.cluster_text(v.cluster_docs(spark, sf_dir), "cluster_id", "doc_pos", "text", records.DOC_SEPARATOR)


# Training records


def _vocabulary(spark, sf_dir):
    return records.vocabulary_ids(profile.token_counts(v.cleaned(spark, sf_dir), "text"))


@query
def vocabulary_ids(spark, sf_dir):
    return _vocabulary(spark, sf_dir)


@query
def encode_tokens(spark, sf_dir):
    docs = v.cleaned(spark, sf_dir)
    ids = records.encode(docs, "doc_id", {"ids": tx.tokens(F.lower(F.col("text")))}, _vocabulary(spark, sf_dir))
    return v.joined_arrays(ids, "ids")


@query
def rec_sentences(spark, sf_dir):
    rows = records.sentence_records(v.cleaned(spark, sf_dir), "doc_id", "text", _vocabulary(spark, sf_dir))
    return v.joined_arrays(rows, "input_ids", "attention_mask")


@query
def rec_seq2seq(spark, sf_dir):
    rows = records.seq2seq_records(v.standard_rows(spark, sf_dir, v.BODY), "doc_id", "articles_clean", "summary_clean", _vocabulary(spark, sf_dir), 1024, 128)
    return v.joined_arrays(rows, "input_ids", "attention_mask", "labels")


@query
def rec_causal(spark, sf_dir):
    chats = v.chat_pairs(spark, sf_dir)
    rows = records.causal_records(
        chats, "pair_id", tx.tokens(F.lower(F.col("source"))), tx.tokens(F.lower(F.col("generated"))), _vocabulary(spark, sf_dir), 2048
    )
    return v.joined_arrays(rows, "input_ids", "attention_mask", "labels")


@query
def head_n(spark, sf_dir):
    return splits.head(v.documents(spark, sf_dir).select("doc_id", "n_chars"), "doc_id", 500)


@query
def batch_manifest(spark, sf_dir):
    return splits.batch_manifest(v.table(spark, sf_dir, "documents"), "doc_id", epochs=2, batch_size=2, accumulation=4)


# Filters, dedup, order, splits


@query
def len_filter(spark, sf_dir):
    return v.standard_rows(spark, sf_dir, v.BODY).where(filters.long_enough(F.col("articles_clean"), F.col("summary_clean"))).select("doc_id", F.length("articles_clean").alias("n_chars"))


@query
def clean_funnel(spark, sf_dir):
    return filters.removal_counts(v.standard_rows(spark, sf_dir, v.BODY))


@query
def trim_p99(spark, sf_dir):
    docs = v.docs_measures(spark, sf_dir).select("doc_id", "compression_ratio")
    return profile.below_quantile(docs, "compression_ratio")


@query
def no_sentences(spark, sf_dir):
    return so.without_sentences(v.cleaned(spark, sf_dir), "text").select("doc_id")


@query
def dedup_apart(spark, sf_dir):
    """The raw documents without exact copies; only texts that may have some are moved."""
    rows = v.documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    return filters.drop_copies_apart(rows, "text", "doc_id").select("doc_id", "source", "lang", F.md5("text").alias("text_md5"))


@query
def dedup_exact(spark, sf_dir):
    return filters.drop_exact_copies(v.cleaned(spark, sf_dir), "text", "doc_id").select("doc_id", "text")


@query
def shuffle_rank(spark, sf_dir):
    return splits.shuffle_rank(v.table(spark, sf_dir, "documents"), "doc_id")


@query
def split_exact(spark, sf_dir):
    return splits.add_split(v.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query
def split_report(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return splits.split_report(splits.add_split(docs, "doc_id"), ("n_chars",))


@query
def eval_slice(spark, sf_dir):
    docs = v.standard_rows(spark, sf_dir, v.BODY).where(filters.long_enough(F.col("articles_clean"), F.col("summary_clean"))).select("doc_id", F.length("articles_clean").alias("n_chars"))
    return splits.position_slice(cut_lineage(docs), "doc_id", 0.9, 50)


@query
def sample_n(spark, sf_dir):
    return splits.sample(v.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 10_000)


@query
def sample_lines(spark, sf_dir):
    return splits.sample(v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_totalprice"), "order_id", 10_000)


@query
def split_leakage(spark, sf_dir):
    return splits.split_overlap(v.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


# Statistics


@query
def token_stats(spark, sf_dir):
    return profile.length_stats(v.docs_clean(spark, sf_dir), ("article_token_count", "summary_token_count"))


@query
def category_counts(spark, sf_dir):
    return profile.value_counts(v.docs_clean(spark, sf_dir), "category", 10)


@query
def source_counts(spark, sf_dir):
    return profile.value_counts(v.docs_clean(spark, sf_dir), "source", 10)


@query
def cluster_stats(spark, sf_dir):
    return profile.group_sizes(v.docs_clean(spark, sf_dir), "category")


@query
def source_stats(spark, sf_dir):
    return profile.group_sizes(v.raw_corpus(spark, sf_dir), "newspaper_name")


@query
def temporal(spark, sf_dir):
    return profile.temporal_coverage(v.docs_clean(spark, sf_dir))


@query
def missing(spark, sf_dir):
    return profile.missing_values(v.raw_corpus(spark, sf_dir))


@query
def schema_report(spark, sf_dir):
    return profile.schema_report(v.docs_clean(spark, sf_dir))


@query
def histogram(spark, sf_dir):
    return profile.histogram(v.docs_measures(spark, sf_dir), "article_token_count")


@query
def ratio_histogram(spark, sf_dir):
    return profile.histogram(profile.below_quantile(v.docs_measures(spark, sf_dir).select("compression_ratio"), "compression_ratio"), "compression_ratio")


@query
def cluster_histogram(spark, sf_dir):
    sizes = v.docs_clean(spark, sf_dir).where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("n"))
    return profile.histogram(cut_lineage(sizes), "n")


@query
def top8_share(spark, sf_dir):
    return profile.top_shares(v.docs_clean(spark, sf_dir), "source", 8)


@query
def boxplot(spark, sf_dir):
    return profile.box_plot(v.docs_measures(spark, sf_dir), "category", "article_token_count", 6)


@query
def boxplot_summary(spark, sf_dir):
    return profile.box_plot(v.docs_measures(spark, sf_dir), "category", "summary_token_count", 6)


@query
def length_pairs(spark, sf_dir):
    docs = v.docs_measures(spark, sf_dir).select("doc_id", "article_token_count", "summary_token_count")
    return splits.sample(docs, "doc_id", 10_000)


@query
def length_grid(spark, sf_dir):
    return profile.length_grid(v.docs_measures(spark, sf_dir), "article_token_count", "summary_token_count")


@query
def corpus_report(spark, sf_dir):
    return profile.corpus_report(v.docs_clean(spark, sf_dir))


# Pairs, sets and graphs


@query
def pairs(spark, sf_dir):
    made = v.pairs(spark, sf_dir)
    return consistency.zip_pairs(made.select("pair_id", "source"), made.select("pair_id", "generated"), made.select("pair_id", "reference"))


def _pair_entities(spark, sf_dir):
    return consistency.add_entities(v.pairs(spark, sf_dir), "[A-Z][a-z]{3,}")


@query
def entity_overlap(spark, sf_dir):
    return _pair_entities(spark, sf_dir).select(
        "pair_id",
        F.size("generated_entities").alias("n_generated"),
        F.size(F.array_intersect("generated_entities", "source_entities")).alias("n_in_source"),
        F.size(F.array_intersect("generated_entities", "reference_entities")).alias("n_in_reference"),
    )


@query
def hallucinated(spark, sf_dir):
    """Against the reference instead of the source, since a source holds all of its generated text."""
    swapped = _pair_entities(spark, sf_dir).withColumn("source_entities", F.col("reference_entities"))
    scored = consistency.add_entity_scores(swapped)
    rows = scored.select("pair_id", "n_hallucinated", F.slice("hallucinated", 1, 5).alias("entities"))
    return v.joined_arrays(rows, "entities")


@query
def sim_edges(spark, sf_dir):
    return dense_graph.similar_pairs(cut_lineage(v.vectors(spark, sf_dir)), 0.2)


@query
def entity_edges(spark, sf_dir):
    return graph.entity_edges(v.vectors(spark, sf_dir))


@query
def entity_groups(spark, sf_dir):
    return dense_graph.entity_groups(cut_lineage(v.vectors(spark, sf_dir)))


@query
def adjacency(spark, sf_dir):
    return graph.adjacency(v.vectors(spark, sf_dir), 0.2)


@query
def adjacency_cluster(spark, sf_dir):
    return graph.adjacency(v.cluster_nodes(spark, sf_dir))


@query
def graph_degree(spark, sf_dir):
    return dense_graph.degree_report(cut_lineage(v.vectors(spark, sf_dir)), 0.2)


def _components(state: DataFrame) -> DataFrame:
    return state.select("cluster_id", "node", F.posexplode("vec").alias("dim", "value"))


@query
def gat_layer(spark, sf_dir):
    return _components(dense_graph.gat_layers(cut_lineage(v.vectors(spark, sf_dir)), [v.layer_weights(64, 8)], 0.2))


@query
def gat_two_layer(spark, sf_dir):
    return _components(dense_graph.gat_layers(cut_lineage(v.vectors(spark, sf_dir)), [v.layer_weights(64, 8), v.layer_weights(8, 8)], 0.2))


@query
def extract_summary(spark, sf_dir):
    return evaluation.summarize(v.cluster_docs(spark, sf_dir), "cluster_id", "doc_pos", "text", v.with_features)


@query
def cluster_inputs(spark, sf_dir):
    return evaluation.cluster_inputs(v.cluster_docs(spark, sf_dir), "cluster_id", "doc_pos", "text")


# Scores


@query
def entity_prf(spark, sf_dir):
    swapped = _pair_entities(spark, sf_dir).withColumn("source_entities", F.col("reference_entities"))
    return consistency.add_entity_scores(swapped).select("pair_id", "entity_precision", "entity_recall", "entity_f1", "n_entities", "n_hallucinated")


@query
def entity_report(spark, sf_dir):
    swapped = _pair_entities(spark, sf_dir).withColumn("source_entities", F.col("reference_entities"))
    return consistency.entity_report(consistency.add_entity_scores(swapped))


@query
def nli_softmax(spark, sf_dir):
    return consistency.add_entailment(v.logits(spark, sf_dir)).drop("logits")


@query
def nli_report(spark, sf_dir):
    return consistency.entailment_report(consistency.add_entailment(v.logits(spark, sf_dir)))


@query
def topic_overlap(spark, sf_dir):
    return consistency.add_topic_overlap(v.chat_pairs(spark, sf_dir)).select("pair_id", "topic_overlap")


@query
def topic_report(spark, sf_dir):
    return consistency.topic_report(consistency.add_topic_overlap(v.chat_pairs(spark, sf_dir)))


@query
def worst_k(spark, sf_dir):
    chats = v.chat_pairs(spark, sf_dir).withColumn("reference", F.col("source"))
    scored = consistency.add_topic_overlap(consistency.add_entity_scores(consistency.add_entities(chats, "[A-Z][a-z]{3,}")))
    entailment = consistency.add_entailment(v.logits(spark, sf_dir)).select(F.concat(F.col("pair_id"), F.lit("-0")).alias("pair_id"), "entailment")
    return v.joined_arrays(consistency.worst_pairs(scored.join(entailment, "pair_id", "left")), "hallucinated", separator="|")


@query
def verdict(spark, sf_dir):
    """Verdict per group of embeddings, with shifted scores standing in for the other two metrics."""
    scored = consistency.add_entailment(v.logits(spark, sf_dir))
    means = scored.groupBy((F.col("pair_id") % 10).alias("model")).agg(
        F.avg("entailment").alias("entailment"), F.avg(1 - F.col("contradiction")).alias("precision"), F.avg(1 - F.col("neutral")).alias("topic")
    )
    return means.withColumn("verdict", consistency.verdict(F.col("precision"), F.col("entailment"), F.col("topic")))


def _rouge_tokens(spark, sf_dir):
    return ngram_scores.token_pairs(v.pairs(spark, sf_dir))


@query
def rouge1(spark, sf_dir):
    return ngram_scores.rouge_n(_rouge_tokens(spark, sf_dir), 1)


@query
def rouge2(spark, sf_dir):
    return ngram_scores.rouge_n(_rouge_tokens(spark, sf_dir), 2)


@query
def rouge_l(spark, sf_dir):
    return ngram_scores.rouge_l(_rouge_tokens(spark, sf_dir))


@query
def rouge_l_chat(spark, sf_dir):
    """The assistant's turn against the user's."""
    chats = v.chat_pairs(spark, sf_dir).withColumn("reference", F.col("source"))
    return ngram_scores.rouge_l(ngram_scores.token_pairs(chats))


@query
def rouge_report(spark, sf_dir):
    return ngram_scores.rouge_report(_rouge_tokens(spark, sf_dir))


@query
def rouge_bootstrap(spark, sf_dir):
    """Means of ROUGE-1 and ROUGE-2 with their intervals over 200 resamples of the pairs."""
    scores = cut_lineage(ngram_scores.rouge_scores(_rouge_tokens(spark, sf_dir)))
    return ngram_scores.bootstrap_means(scores, ("rouge1", "rouge2"), resamples=200)


@query
def rouge_stemmed(spark, sf_dir):
    tokens = evaluation.stemmed_tokens(v.pairs(spark, sf_dir))
    return ngram_scores.rouge_n(tokens, 1)


@query
def score_report(spark, sf_dir):
    pairs = v.pairs(spark, sf_dir).select("pair_id", "generated", "reference")
    report = evaluation.score_report(
        pairs, "third-overlap", v.latency_log(spark, sf_dir), vectors=v.token_vectors(spark, sf_dir), scored=_scored_pairs(spark, sf_dir)
    )
    path = new_folder(spark, "scores")
    writers.write_report(report, path)
    back = readers.read_reports(spark, path, report.schema, multi_line=False)
    facts = [F.col(f"factual_consistency.{part}.*") for part in ("entity_consistency", "nli_consistency", "topic_consistency")]
    return back.select("model", "num_samples", "scores.*", "inference.*", "bertscore_f1", *facts, "factual_consistency.verdict")


@query
def score_report_chat(spark, sf_dir):
    """The complete report on the turns of conversations: the assistant's against the user's."""
    chats = v.chat_pairs(spark, sf_dir).withColumn("reference", F.col("source"))
    scored = consistency.add_topic_overlap(consistency.add_entity_scores(consistency.add_entities(chats, "[A-Z][a-z]{3,}")))
    entailment = consistency.add_entailment(v.logits(spark, sf_dir)).select(F.concat(F.col("pair_id"), F.lit("-0")).alias("pair_id"), "entailment", "contradiction")
    report = evaluation.score_report(
        chats, "chat", v.latency_log(spark, sf_dir), vectors=v.token_vectors(spark, sf_dir), scored=scored.join(entailment, "pair_id", "left")
    )
    facts = [F.col(f"factual_consistency.{part}.*") for part in ("entity_consistency", "nli_consistency", "topic_consistency")]
    return report.select("model", "num_samples", "scores.*", "inference.*", "bertscore_f1", *facts, "factual_consistency.verdict")


@query
def bleu(spark, sf_dir):
    return ngram_scores.corpus_bleu(ngram_scores.token_pairs(v.pairs(spark, sf_dir), ngram_scores.bleu_tokens))


@query
def greedy_vector_f1(spark, sf_dir):
    return ngram_scores.greedy_vector_f1(v.token_vectors(spark, sf_dir))


@query
def latency(spark, sf_dir):
    return runlog.latency_stats(v.latency_log(spark, sf_dir), ["model"])


def _model_scores(spark, sf_dir):
    return runlog.latency_stats(v.latency_log(spark, sf_dir), ["model"])


@query
def leaderboard(spark, sf_dir):
    scores = _model_scores(spark, sf_dir)
    return runlog.leaderboard(scores, "model", {"mean_latency": False, "p95_latency": False, "tokens_per_sec": True})


@query
def best_models(spark, sf_dir):
    board = runlog.leaderboard(_model_scores(spark, sf_dir), "model", {"mean_latency": False, "p95_latency": False, "tokens_per_sec": True})
    return runlog.best_per_metric(board)


@query
def report_checks(spark, sf_dir):
    flat = runlog.flatten_benchmarks(_read_benchmarks(spark, sf_dir))
    rules = {
        "median <= p95": "median_latency_sec <= p95_latency_sec",
        "median <= mean": "median_latency_sec <= mean_latency_sec",
        "rate is 1 / mean": "abs(mean_latency_sec * throughput_samples_per_sec - 1) < 1e-9",
        "more than 2000 samples": "num_samples > 2000",
    }
    return runlog.check_reports(flat, rules)


def _language_reports(spark, sf_dir):
    """A report a language: its documents as training rows, the scores of its pairs."""
    tokens = ngram_scores.token_pairs(v.pairs(spark, sf_dir))
    scores = ngram_scores.rouge_scores(tokens)
    docs = v.documents(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), F.col("lang").alias("model"), "n_chars")
    sums = docs.join(scores, "pair_id").groupBy("model").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.avg("rouge1").alias("rouge1"), F.avg("rouge2").alias("rouge2")
    )
    none = F.lit(None).cast("double")
    return sums.select(
        "model",
        F.lit("seq2seq").alias("architecture"),
        F.lit("full").alias("training_strategy"),
        F.struct(
            F.col("n").alias("train_samples"), F.lit(1).cast("long").alias("epochs"), F.ceil(F.col("n") / 8).alias("total_steps"),
            (F.col("chars") / 1000).alias("training_time_sec"), F.array(F.struct(F.lit(1).cast("long").alias("step"), none.alias("loss"))).alias("loss_log"),
        ).alias("training"),
        F.struct(F.col("n").alias("eval_samples"), "rouge1", "rouge2", none.alias("rougeL"), none.alias("bertscore_f1")).alias("evaluation"),
        F.struct(none.alias("mean_latency_sec"), none.alias("median_latency_sec"), none.alias("throughput_samples_per_sec")).alias("inference"),
    )


def _read_trainings(spark, sf_dir):
    path = new_folder(spark, "training_reports")
    writers.write_reports(_language_reports(spark, sf_dir), path)
    return runlog.flatten_trainings(readers.read_reports(spark, path, readers.TRAINING_REPORT_SCHEMA))


@query
def trainings_flatten(spark, sf_dir):
    return _read_trainings(spark, sf_dir).select("model", "train_samples", "epochs", "total_steps", "training_time_sec", "n_losses", "eval_samples", "rouge1", "rouge2")


@query
def rouge_rules(spark, sf_dir):
    return runlog.check_reports(_read_trainings(spark, sf_dir), runlog.REPORT_RULES)


@query
def quality_board(spark, sf_dir):
    """Leaderboard of a published score table."""
    path = new_folder(spark, "score_table")
    table = _language_reports(spark, sf_dir).select(F.col("model").alias("Model"), F.col("evaluation.rouge1").alias("ROUGE-1"), F.col("evaluation.rouge2").alias("ROUGE-2"))
    writers.write_raw(table, path, "csv")
    scores = readers.read_score_table(spark, path, table.schema).toDF("model", "rouge1", "rouge2")
    return runlog.leaderboard(scores, "model", {"rouge1": True, "rouge2": True})


# Run logs


@query
def run_steps(spark, sf_dir):
    return v.run_log(spark, sf_dir)


@query
def running_loss(spark, sf_dir):
    return runlog.running_mean(cut_lineage(v.run_log(spark, sf_dir)), ["run"], "step", "loss", block=500)


@query
def running_epoch_loss(spark, sf_dir):
    return runlog.running_mean(cut_lineage(v.run_log(spark, sf_dir)), ["run", "epoch"], "step", "loss")


@query
def epoch_loss(spark, sf_dir):
    return runlog.epoch_means(v.run_log(spark, sf_dir), ["run", "epoch"], "loss")


@query
def best_so_far(spark, sf_dir):
    epochs = runlog.epoch_means(v.run_log(spark, sf_dir), ["run", "epoch"], "loss")
    return runlog.best_so_far(cut_lineage(epochs), ["run"], "epoch", "avg_loss", block=8)


@query
def checkpoints(spark, sf_dir):
    return runlog.periodic(v.run_log(spark, sf_dir), "step", 50)


@query
def loss_tail(spark, sf_dir):
    """One report per epoch; losses above 5 are written as NaN, as a diverged run logs them."""
    entry = F.struct("step", F.when(F.col("loss") > 5, F.lit(float("nan"))).otherwise(F.col("loss")).alias("loss"))
    epochs = v.run_log(spark, sf_dir).groupBy("run", "epoch").agg(F.collect_list(entry).alias("loss_log"))
    reports = epochs.select(
        F.concat_ws("-", "run", "epoch").alias("model"),
        F.struct(F.lit(1).cast("bigint").alias("epochs"), F.col("loss_log")).alias("training"),
    )
    path = new_folder(spark, "trainings")
    writers.write_samples(reports, path)
    back = readers.read_reports(spark, path, readers.TRAINING_REPORT_SCHEMA, multi_line=False)
    return runlog.loss_tail(back).withColumn("is_nan", F.col("is_nan").cast("string"))


@query
def corpus_by_language(spark, sf_dir):
    """Flagship: clean, filter, deduplicate and count, then report lengths and shares per language."""
    docs = v.docs_clean(spark, sf_dir)
    per = docs.groupBy("category").agg(
        F.count("*").alias("n_docs"),
        F.sum("article_token_count").alias("n_tokens"),
        F.avg("article_token_count").alias("mean_tokens"),
        F.percentile("article_token_count", F.lit(0.5)).alias("median_tokens"),
        F.max("article_token_count").alias("max_tokens"),
        F.avg("compression_ratio").alias("mean_ratio"),
    )
    per = cut_lineage(per)
    total = per.agg(F.sum("n_docs").alias("_total"))
    return per.crossJoin(F.broadcast(total)).select("*", (F.col("n_docs") * 100 / F.col("_total")).alias("percent")).drop("_total")
