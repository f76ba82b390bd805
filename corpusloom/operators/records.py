"""Model-ready records: token ids, padding, masks, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import sentences as st
from corpusloom.functions import text as tx
from corpusloom.operators import ranking as rk
from corpusloom.operators.lookup import looked_up
from corpusloom.shared import DICTIONARY_BYTES, computed_once, cut_lineage

# Fixed value: labels with this id do not enter the loss.
IGNORED = -100
PAD, UNKNOWN, END = 0, 1, 2
SPECIALS = ("[PAD]", "[UNK]", "[EOS]")
DOC_SEPARATOR = " [DOC] "
PROMPT = "Summarize the articles below in a few factual sentences; state nothing they do not state.\n\nArticles:\n"
PROMPT_END = "\n\nSummary:"


def vocabulary_ids(token_counts: DataFrame, size: int | None = None) -> DataFrame:
    """``(token, token_id)`` of all tokens, or of the ``size`` most frequent ones; ids 0 to 2 are padding, unknown, end.

    All tokens are ranked in ranges of (frequency, token); a bounded choice is ordered in one task.
    """
    if size is None:
        counts = token_counts.select("token", (-F.col("n")).alias("_down"))
        ranked = rk.add_rank(rk.range_part(counts, ["_down", "token"], "_part"), ["_down", "token"], "_part")
        return ranked.select("token", (F.col("rank") + (len(SPECIALS) - 1)).cast("int").alias("token_id"))
    top = token_counts.orderBy(F.desc("n"), "token").limit(size)
    order = Window.orderBy(F.desc("n"), "token")
    return top.select("token", (F.row_number().over(order) + (len(SPECIALS) - 1)).cast("int").alias("token_id"))


def _line(tokens: Column) -> Column:
    return F.coalesce(F.array_join(tokens, " "), F.lit(""))


def _found_ids(df: DataFrame, id_col: str, lines: Column, vocabulary: DataFrame, max_bytes: int) -> DataFrame:
    """``(id, _found)``: lines of blank-separated tokens as an array of ids a line."""
    table = cut_lineage(vocabulary.select("token", F.col("token_id").cast("int").alias("token_id"), F.col("token_id").alias("_order")))
    return looked_up(df, [id_col], {"_found": lines}, table, lambda t: UNKNOWN, max_bytes)


def encode(df: DataFrame, id_col: str, texts: dict[str, Column], vocabulary: DataFrame, max_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """``(id, name...)``: token arrays turned into id arrays, an unknown token into ``UNKNOWN``; tokens hold no white space.

    Tokens are replaced where they lie (``lookup.looked_up``): of a vocabulary of more than ``max_bytes`` the smallest ids, which
    are the most frequent tokens, are a dictionary, and only other tokens become rows, one for each that a text has.
    """
    found = _found_ids(df, id_col, F.concat_ws("\n", *[_line(c) for c in texts.values()]), vocabulary, max_bytes)
    return found.select(id_col, *[F.get("_found", F.lit(part)).alias(name) for part, name in enumerate(texts)])


def pad(ids: Column, length: int, value: int = PAD) -> Column:
    """Cut or fill to exactly ``length``."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(value), F.lit(length) - F.size(cut)))


def mask(ids: Column, length: int) -> Column:
    """1 for a token, 0 for padding."""
    used = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(length) - used))


def sentence_records(
    df: DataFrame,
    id_col: str,
    text_col: str,
    vocabulary: DataFrame,
    slots: int = st.SLOTS,
    length: int = 64,
    max_bytes: int = DICTIONARY_BYTES,
) -> DataFrame:
    """``(id, n_sentences, input_ids, attention_mask)``: a slots x length matrix per text."""
    sentences = st.first_sentences(st.split_sentences(F.col(text_col)), slots)
    words = F.transform(sentences, lambda s: F.slice(tx.tokens(F.lower(s)), 1, length))
    lines = F.coalesce(F.array_join(F.transform(words, _line), "\n"), F.lit(""))
    gathered = _found_ids(df, id_col, lines, vocabulary, max_bytes)
    none = F.array().cast("array<int>")
    rows = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda slot: F.coalesce(F.get("_found", slot), none))
    return computed_once(gathered, {"_ids": rows}).select(
        id_col,
        F.size(F.filter("_ids", lambda row: F.size(row) > 0)).cast("bigint").alias("n_sentences"),
        F.transform("_ids", lambda row: pad(row, length)).alias("input_ids"),
        F.transform("_ids", lambda row: mask(row, length)).alias("attention_mask"),
    )


def seq2seq_records(
    df: DataFrame, id_col: str, article_col: str, summary_col: str, vocabulary: DataFrame, input_length: int = 4096, target_length: int = 128
) -> DataFrame:
    """``(id, input_ids, attention_mask, labels)``; padding is ignored in the labels."""
    ids = encode(
        df,
        id_col,
        {
            "article": F.slice(tx.tokens(F.lower(F.col(article_col))), 1, input_length),
            "summary": F.slice(tx.tokens(F.lower(F.col(summary_col))), 1, target_length),
        },
        vocabulary,
    )
    return ids.select(
        id_col,
        pad(F.col("article"), input_length).alias("input_ids"),
        mask(F.col("article"), input_length).alias("attention_mask"),
        pad(F.col("summary"), target_length, IGNORED).alias("labels"),
    )


def prompt(article: Column) -> Column:
    return F.concat(F.lit(PROMPT), article, F.lit(PROMPT_END))


def prompt_records(df: DataFrame, id_col: str, article: Column, summary: Column, end: str = SPECIALS[END]) -> DataFrame:
    """``(id, prompt, full_text)``: prompt, blank, summary, end mark."""
    return df.select(
        id_col, prompt(article).alias("prompt"), F.concat(prompt(article), F.lit(" "), summary, F.lit(end)).alias("full_text")
    )


def causal_records(
    df: DataFrame, id_col: str, prompt_tokens: Column, completion_tokens: Column, vocabulary: DataFrame, length: int = 2048
) -> DataFrame:
    """``(id, prompt_len, input_ids, attention_mask, labels)``: prompt, completion and end mark in one row
    of ``length`` ids; prompt and padding are ignored in the labels."""
    encoded = encode(df, id_col, {"prompt": F.slice(prompt_tokens, 1, length), "completion": F.slice(completion_tokens, 1, length)}, vocabulary)
    full = encoded.select(
        id_col,
        F.size("prompt").alias("_n"),
        F.slice(F.concat("prompt", "completion", F.array(F.lit(END))), 1, length).alias("_ids"),
    )
    hidden = F.array_repeat(F.lit(IGNORED), F.least("_n", F.size("_ids")))
    learned = F.concat(hidden, F.slice("_ids", F.col("_n") + 1, length))
    return full.select(
        id_col,
        F.col("_n").cast("bigint").alias("prompt_len"),
        pad(F.col("_ids"), length).alias("input_ids"),
        mask(F.col("_ids"), length).alias("attention_mask"),
        pad(learned, length, IGNORED).alias("labels"),
    )
