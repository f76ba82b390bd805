"""Sentence rows, entity rows and clusters of documents."""

from __future__ import annotations

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import entities as en
from corpusloom.functions import sentences as st
from corpusloom.shared import BROADCAST_ROWS, DICTIONARY_BYTES, cut_lineage, dictionary, lookup_join


def sentence_rows(df: DataFrame, id_col: str, text_col: str, min_len: int = 10, first: int | None = None) -> DataFrame:
    """``(id, pos, sentence)``; ``pos`` counts kept sentences from 0. ``first`` keeps that many per text."""
    sentences = st.split_sentences(F.col(text_col), min_len)
    if first is not None:
        sentences = st.first_sentences(sentences, first)
    return df.select(id_col, F.posexplode(sentences).alias("pos", "sentence"))


def without_sentences(df: DataFrame, text_col: str, min_len: int = 10) -> DataFrame:
    """Rows that a per-sentence job skips."""
    sentences = F.coalesce(F.size(st.split_sentences(F.col(text_col), min_len)), F.lit(0))
    return df.where(sentences == 0)


def _labelled(entities: Column, label: str | None) -> Column:
    return F.transform(entities, lambda e: F.struct(e.alias("entity"), F.lit(label).cast("string").alias("label")))


#: The list of names that this worker saw last, and its automaton.
_last: tuple[dict, object] | None = None


def _automaton(names: dict[str, str]):
    """The automaton for the listed names, each between blanks, built once in a worker."""
    global _last
    if _last is None or _last[0] is not names:
        import ahocorasick

        made = ahocorasick.Automaton()
        for entity, labels in names.items():
            made.add_word(f" {entity} ", [f"{entity}\t{label}" for label in labels.split("\t")])
        made.make_automaton()
        _last = names, made
    return _last[1]


def _listed_names(names: Broadcast[dict]):
    """Arrow UDF: runs of words, with bars between them -> the listed names in them, with their labels."""

    @F.pandas_udf("array<string>")
    def found(runs: pd.Series) -> pd.Series:
        search = _automaton(names.value)
        if not len(search):
            return pd.Series([[]] * len(runs))
        return pd.Series([list(dict.fromkeys(hit for _, hits in search.iter(line) for hit in hits)) for line in runs], dtype="object")

    return found


def entity_rows(
    df: DataFrame,
    id_col: str,
    text_col: str,
    gazetteer: DataFrame,
    labels: tuple[str, ...] = en.NAME_LABELS,
    pattern: str = en.NAME_PATTERN,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = DICTIONARY_BYTES,
) -> DataFrame:
    """Distinct ``(id, entity, label)``: name mentions that the gazetteer ``(entity, label)`` lists, plus
    dates and sums of money, which are found by their form. The texts are read once for all kinds.

    A run of capitalized words is searched whole and in all its parts. While the list fits a dictionary by its bytes, an automaton of
    all names goes through the runs where they lie, once, however many names there are; a larger list is joined to the parts
    of up to as many words as its longest name.
    """
    text = F.col(text_col)
    forms = [(label, form) for label, form in (("DATE", en.DATE_PATTERN), ("MONEY", en.MONEY_PATTERN)) if label in labels]
    listed = gazetteer.where(F.col("label").isin(*labels)).select("entity", "label").distinct()
    names = dictionary(cut_lineage(listed.groupBy("entity").agg(F.array_join(F.sort_array(F.collect_set("label")), "\t").alias("labels"))), max_bytes)
    if names is not None:
        runs = F.concat(F.lit(" "), F.array_join(en.mentions(text, pattern), " | "), F.lit(" "))
        hits = F.transform(_listed_names(names)(runs), lambda h: F.struct(F.split_part(h, F.lit("\t"), F.lit(1)).alias("entity"), F.split_part(h, F.lit("\t"), F.lit(2)).alias("label")))
        dated = [_labelled(en.mentions(text, form), label) for label, form in forms]
        return df.select(id_col, F.inline(F.array_distinct(F.concat(hits, *dated)))).distinct()
    longest = gazetteer.agg(F.max(F.size(F.split("entity", " ")))).first()[0] or 1
    found = [_labelled(en.parts(en.mentions(text, pattern), longest), None), *[_labelled(en.mentions(text, form), label) for label, form in forms]]
    rows = df.select(id_col, F.inline(F.concat(*found)))
    listed = gazetteer.where(F.col("label").isin(*labels)).select("entity", F.col("label").alias("listed"))
    by_form = F.col("label").isNotNull()
    joined = lookup_join(rows, listed, ["entity"], F.col(id_col), "left", max_rows)
    kept = joined.select(id_col, "entity", F.when(by_form, F.col("label")).otherwise(F.col("listed")).alias("label")).where("label is not null")
    return kept.distinct() if forms else kept


def cluster_text(docs: DataFrame, cluster_col: str, pos_col: str, text_col: str, separator: str = " ") -> DataFrame:
    """``(cluster, n_docs, text)``: the documents of a cluster joined in order, a row a cluster of any size."""
    doc = F.struct(F.col(pos_col).alias("pos"), F.col(text_col).alias("text"))
    ordered = F.sort_array(F.collect_list(doc))
    return docs.groupBy(cluster_col).agg(
        F.count("*").alias("n_docs"), F.array_join(F.transform(ordered, lambda d: d["text"]), separator).alias("text")
    )


def cluster_sentences(
    docs: DataFrame, cluster_col: str, pos_col: str, text_col: str, slots: int | None = None, min_len: int = 10
) -> DataFrame:
    """``(cluster, pos, sentence)``: the sentences of a cluster in document order, or those that fill its ``slots``.

    A sentence does not run on into the next document. Without ``slots`` a document's sentences start at the number of
    sentences before it, which is one row a document, so texts are not moved, however large the cluster. With ``slots``
    every task drops what lies beyond them before the shuffle.
    """
    sentences = st.split_sentences(F.col(text_col), min_len)
    if slots is None:
        sizes = docs.select(cluster_col, F.col(pos_col).alias("_doc"), F.coalesce(F.size(sentences), F.lit(0)).cast("bigint").alias("_n"))
        before = Window.partitionBy(cluster_col).orderBy("_doc").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        rows = docs.select(cluster_col, F.col(pos_col).alias("_doc"), F.posexplode(sentences).alias("_pos", "sentence"))
        return rows.join(starts, [cluster_col, "_doc"]).select(cluster_col, (F.col("_start") + F.col("_pos")).alias("pos"), "sentence")
    rows = docs.select(cluster_col, F.col(pos_col).alias("_doc"), F.posexplode(st.first_sentences(sentences, slots)).alias("_pos", "sentence"))
    order = Window.partitionBy(cluster_col).orderBy("_doc", "_pos")
    ranked = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= slots)
    return ranked.select(cluster_col, (F.col("_rank") - 1).cast("bigint").alias("pos"), "sentence")
