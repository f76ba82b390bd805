"""Readers with declared schemas; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources import excel

RAW_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("newspaper_name", T.StringType()),
        T.StructField("published_date", T.StringType()),
        T.StructField("headline", T.StringType()),
        T.StructField("article_text", T.StringType()),
        T.StructField("human_summary", T.StringType()),
        T.StructField("news_category", T.StringType()),
    ]
)

BENCHMARK_REPORT_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("params_total", T.LongType()),
        T.StructField("params_m", T.StringType()),
        T.StructField("model_type", T.StringType()),
        T.StructField(
            "inference",
            T.StructType(
                [
                    T.StructField("num_samples", T.LongType()),
                    T.StructField("mean_latency_sec", T.DoubleType()),
                    T.StructField("median_latency_sec", T.DoubleType()),
                    T.StructField("p95_latency_sec", T.DoubleType()),
                    T.StructField("throughput_samples_per_sec", T.DoubleType()),
                    T.StructField("throughput_tokens_per_sec", T.DoubleType()),
                    T.StructField("avg_generated_tokens", T.DoubleType()),
                ]
            ),
        ),
        T.StructField(
            "system",
            T.StructType(
                [
                    T.StructField("gpu", T.StringType()),
                    T.StructField("peak_vram_gb", T.DoubleType()),
                    T.StructField("ram_gb", T.DoubleType()),
                ]
            ),
        ),
    ]
)

LOSS_ENTRY = T.StructType([T.StructField("step", T.LongType()), T.StructField("loss", T.DoubleType())])

TRAINING_REPORT_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("architecture", T.StringType()),
        T.StructField("training_strategy", T.StringType()),
        T.StructField(
            "training",
            T.StructType(
                [
                    T.StructField("train_samples", T.LongType()),
                    T.StructField("epochs", T.LongType()),
                    T.StructField("total_steps", T.LongType()),
                    T.StructField("training_time_sec", T.DoubleType()),
                    T.StructField("loss_log", T.ArrayType(LOSS_ENTRY)),
                ]
            ),
        ),
        T.StructField(
            "evaluation",
            T.StructType(
                [
                    T.StructField("eval_samples", T.LongType()),
                    T.StructField("rouge1", T.DoubleType()),
                    T.StructField("rouge2", T.DoubleType()),
                    T.StructField("rougeL", T.DoubleType()),
                    T.StructField("bertscore_f1", T.DoubleType()),
                ]
            ),
        ),
        T.StructField(
            "inference",
            T.StructType(
                [
                    T.StructField("mean_latency_sec", T.DoubleType()),
                    T.StructField("median_latency_sec", T.DoubleType()),
                    T.StructField("throughput_samples_per_sec", T.DoubleType()),
                ]
            ),
        ),
    ]
)


def read_raw(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Raw article table from ``csv``, ``json`` (one object per line), ``parquet``, ``orc`` or ``xlsx`` (see ``sources.excel``).

    An empty CSV cell reads as NULL, as an empty cell of a sheet does; a sheet of a workbook is one task. CSV fields may hold quotes and line breaks, which makes a CSV file one task: spread a large corpus
    over many files, or take one of the splittable formats.
    """
    if fmt == "xlsx":
        excel.register(spark)
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, quote='"', escape='"')
    return reader.format(fmt).load(path)


#: What a reader says about a row besides its columns.
BAD_RECORD, SOURCE_FILE = "bad_record", "source_file"


def read_checked(spark: SparkSession, path: str, fmt: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Rows of ``csv`` or ``json`` (one a line) with ``bad_record``, the whole line where it does not fit the schema, and
    ``source_file``.

    A line is bad that cannot be parsed, has too few or too many fields (CSV), or holds a value that is not of its column's type. No
    line is lost and none ends the job. Files are split by lines, so a quoted line break counts as the end of a CSV row here.
    """
    if fmt not in ("csv", "json"):
        raise ValueError("only text formats can hold rows that do not fit")
    checked = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_RECORD}
    if fmt == "csv":
        options |= {"header": "true", "quote": '"', "escape": '"', "enforceSchema": "true"}
    rows = spark.read.schema(checked).options(**options).format(fmt).load(path)
    return rows.withColumn(SOURCE_FILE, F.input_file_name())


def fitting(checked: DataFrame) -> DataFrame:
    """The rows that fit the schema, with its columns only."""
    return checked.where(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD, SOURCE_FILE)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Clean corpus written by ``sources.writers.write_corpus``."""
    return spark.read.parquet(path)


def read_reports(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Run reports, one JSON document per file, or one per line with ``multi_line=False``.

    ``NaN`` is accepted where the schema says DOUBLE.
    """
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def read_score_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Published score or cost table (CSV with a header line)."""
    return spark.read.schema(schema).csv(path, header=True)
