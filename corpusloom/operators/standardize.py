"""Column names, cleaned columns, dates and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

# Raw column name -> standard name.
COLUMN_NAMES = {
    "newspaper_name": "source",
    "published_date": "date",
    "headline": "headline",
    "article_text": "articles",
    "human_summary": "summary",
    "news_category": "category",
}
# Columns of the clean corpus, in order.
CORPUS_COLUMNS = (
    "source", "date", "year", "headline", "articles_clean", "summary_clean", "category",
    "article_token_count", "summary_token_count", "compression_ratio",
)
TEXT_COLUMNS = ("articles", "summary", "headline")
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "MMMM d, yyyy", "d MMMM yyyy")


def standardize_names(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Trim column names, drop line breaks in them, then rename; names that are absent are skipped."""
    tidy = df.toDF(*[name.strip().replace("\n", "") for name in df.columns])
    return tidy.withColumnsRenamed(names or COLUMN_NAMES)


def add_clean_columns(df: DataFrame, columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    return df.withColumns({f"{c}_clean": tx.clean_text(F.col(c)) for c in columns if c in df.columns})


def parse_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First format that fits; NULL where none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in formats])


def add_dates(df: DataFrame, column: str = "date", formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    if column not in df.columns:
        return df
    dated = df.withColumn(column, parse_date(F.col(column), formats))
    return dated.withColumn("year", F.year(column))


def bad_dates(df: DataFrame, column: str = "date", formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """Rows whose date is given but cannot be read."""
    return df.where(F.col(column).isNotNull() & parse_date(F.col(column), formats).isNull())


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as DOUBLE, NULL where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def add_token_counts(df: DataFrame) -> DataFrame:
    counts = {
        target: tx.count_tokens(F.col(source), collapsed=True)
        for target, source in (
            ("article_token_count", "articles_clean"),
            ("summary_token_count", "summary_clean"),
        )
        if source in df.columns
    }
    counted = df.withColumns(counts) if counts else df
    if len(counts) < 2:
        return counted
    return counted.withColumn("compression_ratio", ratio(F.col("article_token_count"), F.col("summary_token_count")))


def select_existing(df: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def strings_only(df: DataFrame, columns: tuple[str, ...], null_label: str | None = None) -> DataFrame:
    """Cast to STRING. NULL stays NULL unless ``null_label`` names the text to put in its place."""

    def cast(c: str) -> Column:
        text = F.col(c).cast("string")
        return text if null_label is None else F.coalesce(text, F.lit(null_label))

    return df.withColumns({c: cast(c) for c in columns if c in df.columns})
