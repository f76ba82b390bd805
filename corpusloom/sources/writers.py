"""Writers. Each keeps the partitioning it is given: one file per task, nothing gathered first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources import excel
from corpusloom.sources.readers import BAD_RECORD, SOURCE_FILE


def write_raw(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """``csv``, ``json``, ``parquet``, ``orc`` or ``xlsx``, a workbook a task."""
    if fmt == "xlsx":
        excel.register(df.sparkSession)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.options(header=True, quote='"', escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.format(fmt).save(path)


def write_corpus(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One table with a folder per split, so that a reader of one split never opens the others."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """One nested row as one JSON document."""
    report.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_reports(reports: DataFrame, path: str) -> None:
    """A file a report, as an indented JSON document (the form in which runs publish theirs)."""
    document = F.to_json(F.struct(*reports.columns), {"pretty": "true", "ignoreNullFields": "false"})
    reports.select(document.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Per-pair results, one JSON object per line."""
    samples.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_quarantine(checked: DataFrame, path: str) -> None:
    """The lines of ``readers.read_checked`` that do not fit, whole, with their files, a folder for each kind of fault.

    ``broken`` lines cannot be parsed; ``misfit`` ones can, but some value or the number of fields does not fit. A line is
    broken if no column of it could be read.
    """
    columns = [c for c in checked.columns if c not in (BAD_RECORD, SOURCE_FILE)]
    kind = F.when(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull(), "broken").otherwise("misfit")
    bad = checked.where(F.col(BAD_RECORD).isNotNull()).select(BAD_RECORD, SOURCE_FILE, kind.alias("kind"))
    bad.write.mode("overwrite").partitionBy("kind").json(path)
