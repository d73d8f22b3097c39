"""Reading and writing tables. Stages exchange Parquet; JSON lines and CSV are
read with an explicit schema, so no inference pass runs over the data. A
missing input fails at plan time with Spark's PATH_NOT_FOUND."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from labelwright.contracts import RAW_REVIEW

# Review texts hold quotes and line breaks.
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
# Blanks at the ends belong to the text. An empty text is read as missing.
CSV_READ = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CSV_WRITE = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def scan_json(spark: SparkSession, path: str, schema: StructType = RAW_REVIEW) -> DataFrame:
    """JSON lines; a line that cannot be read becomes a row of nulls."""
    return spark.read.schema(schema).json(path, mode="PERMISSIVE")


def scan_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS, **CSV_READ).csv(path)


def sink_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**CSV_WRITE).csv(path)


def sink_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def report_sink(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Reports are small long tables: one text file, readable as CSV."""
    sink_csv(report.coalesce(1), path, mode)
