"""The append-only log of model answers: what a restarted run does not ask again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelwright.operators.relabel import LOG_SCHEMA
from labelwright.session import discard, spool


def append_answers(answers: DataFrame, path: str) -> None:
    answers.write.mode("append").parquet(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """The log, empty if nothing was written yet."""
    log = _if_there(lambda: spark.read.schema(LOG_SCHEMA).parquet(path))
    return spark.createDataFrame([], LOG_SCHEMA) if log is None else log


def _if_there(read: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return None


def adopt(spark: SparkSession, journal: str, path: str) -> None:
    """Move what a stopped job left in its journal into the log; what the log has is not added."""
    kept = _if_there(
        lambda: spark.read.schema(LOG_SCHEMA).option("pathGlobFilter", "*.json").json(journal)
    )
    if kept is None:
        return
    known = answered_ids(read_answers(spark, path))
    fresh = kept.withColumn("row_id", F.col("row_ids")[0]).join(known, "row_id", "left_anti")
    append_answers(spool(fresh.select(*kept.columns), "adopted"), path)
    discard(spark, journal)


def answered_ids(log: DataFrame) -> DataFrame:
    return log.select(F.explode("row_ids").alias("row_id"))
