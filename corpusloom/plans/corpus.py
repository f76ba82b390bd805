"""From raw articles to a clean corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import filters, standardize
from corpusloom.shared import computed_once


def standardized(raw: DataFrame, texts: tuple[str, ...] = standardize.TEXT_COLUMNS) -> DataFrame:
    """Standard names, cleaned text columns, dates and years; every input row is kept."""
    named = standardize.standardize_names(raw)
    texts = [c for c in texts if c in named.columns]
    cleaned = {f"{c}_clean": tx.clean_text(F.col(c)) for c in texts}
    return standardize.add_dates(computed_once(named, cleaned) if cleaned else named)


def clean_corpus(raw: DataFrame, id_col: str = "doc_id", null_label: str | None = None) -> DataFrame:
    """Clean, filter by length, drop exact copies (smallest id stays), count tokens; ``id_col`` comes first.

    The order matters: copies are looked for among the rows that pass the length filters. The headline is
    kept as it came. A step whose column is missing is left out.
    """
    named = standardized(raw, ("articles", "summary"))
    texts = {c: F.col(c) if c in named.columns else None for c in ("articles_clean", "summary_clean")}
    unique = named.where(filters.long_enough(*texts.values())).drop("articles", "summary")
    if texts["articles_clean"] is not None:
        unique = filters.drop_exact_copies(unique, "articles_clean", id_col)
    counted = standardize.add_token_counts(unique)
    named = standardize.strings_only(counted, ("source", "headline", "category"), null_label)
    return standardize.select_existing(named, (id_col, *standardize.CORPUS_COLUMNS))
