"""Length filters, removal counts, exact deduplication."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.shared import BROADCAST_ROWS, cut_lineage, fits_broadcast, stored

MIN_ARTICLE_CHARS = 100
MIN_SUMMARY_CHARS = 20
#: Bits that tell which texts may have copies, at most.
BITMAP_BITS = 1 << 28


def long_enough(
    article: Column | None = None,
    summary: Column | None = None,
    min_article: int = MIN_ARTICLE_CHARS,
    min_summary: int = MIN_SUMMARY_CHARS,
) -> Column:
    """Every given text is longer than its bound; NULL counts as too short."""
    kept = F.lit(True)
    for text, bound in ((article, min_article), (summary, min_summary)):
        if text is not None:
            kept = kept & F.coalesce(F.length(text) > bound, F.lit(False))
    return kept


def text_key(text: Column) -> Column:
    """Fixed-size stand-in for a text, so that no shuffle is keyed by whole texts."""
    return F.sha2(text, 256)


def drop_exact_copies(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Keep the row with the smallest id of each distinct text. Rows without text form one group.

    Every task keeps its own first row of a text before the shuffle (Spark limits a window group early
    when only the first row number is wanted), so a text that makes up a third of all rows costs one row
    per task. The data is read, and the text computed, once.
    """
    first = Window.partitionBy("_key").orderBy(id_col)
    keyed = df.withColumn("_key", F.coalesce(text_key(F.col(text_col)), F.lit("")))
    ranked = keyed.withColumn("_rank", F.row_number().over(first))
    return ranked.where("_rank = 1").drop("_key", "_rank")


def drop_copies_apart(df: DataFrame, text_col: str, id_col: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same rows as ``drop_exact_copies``, moving only texts that may have copies.

    The rows are stored with two hashes of their texts. Hashes and ids alone are shuffled to find the texts that occur more than
    once, with their smallest ids. While these fit a broadcast, no text is shuffled at all. Beyond that a bitmap of their hashes,
    of a bounded size, goes to all tasks: a row that it does not know has no copy and stays where it is; the others, those with
    copies and a few more, are joined to the smallest ids. A full bitmap only means that more rows are moved.
    """
    text = F.col(text_col)
    keys = [F.when(text.isNull(), 0).otherwise(F.xxhash64(text)).alias("_k1"), F.when(text.isNull(), 0).otherwise(F.xxhash64(F.lit("second"), text)).alias("_k2")]
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = stored(df.select(whole.alias("_row"), F.col(id_col).alias("_id"), *keys), "keyed")
    copies = rows.groupBy("_k1", "_k2").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    copies = cut_lineage(copies.where("_n > 1").drop("_n"))
    stays = F.col("_first").isNull() | (F.col("_id") == F.col("_first"))
    if fits_broadcast(copies, max_rows):
        return rows.join(F.broadcast(copies), ["_k1", "_k2"], "left").where(stays).select("_row.*")
    known = _bitmap(copies)
    marked = rows.withColumn("_met", _in_bitmap(known)("_k1"))
    suspects = marked.where("_met").join(copies, ["_k1", "_k2"], "left").where(stays)
    return marked.where("NOT _met").select("_row.*").union(suspects.select("_row.*"))


def _bitmap(copies: DataFrame) -> Broadcast[np.ndarray]:
    """Bits of the hashes ``_k1``, some sixteen for each, at most ``BITMAP_BITS`` (32 MB)."""
    bits = min(BITMAP_BITS, 1 << max(16, (16 * copies.count()).bit_length()))
    place = F.pmod("_k1", F.lit(bits))
    words = copies.groupBy((F.shiftright(place, 6)).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(_k1, {bits}) % 64 as int))")).alias("bits"))
    found = words.toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return copies.sparkSession.sparkContext.broadcast(table)


def _in_bitmap(known: Broadcast[np.ndarray]):
    @F.pandas_udf("boolean")
    def met(keys: pd.Series) -> pd.Series:
        place = keys.to_numpy() % (64 * len(known.value))
        return pd.Series((known.value[place >> 6].view(np.uint64) >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return met


def removal_counts(
    df: DataFrame,
    article_col: str = "articles_clean",
    summary_col: str = "summary_clean",
    min_article: int = MIN_ARTICLE_CHARS,
    min_summary: int = MIN_SUMMARY_CHARS,
) -> DataFrame:
    """Rows in, rows dropped by length, rows dropped as copies, rows out, from one pass over the data."""
    keep = long_enough(F.col(article_col), F.col(summary_col), min_article, min_summary)
    counts = df.select(keep.alias("keep"), F.when(keep, text_key(F.col(article_col))).alias("key")).agg(
        F.count("*").alias("n_in"),
        F.count_if("keep").alias("n_long"),
        F.count_distinct("key").alias("n_out"),
    )
    return counts.select(
        "n_in",
        (F.col("n_in") - F.col("n_long")).alias("n_short"),
        (F.col("n_long") - F.col("n_out")).alias("n_copies"),
        "n_out",
    )
