"""The training-data pipeline over ``documents``: stages in order, each with its function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelwright.llm.common import table
from labelwright.llm.stages import mixed, not_toxic, one_of_each, tokens, without_secrets
from labelwright.session import spool

STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("bpe", tokens),
]
#: The first stage learns a model, which SQL cannot express; tests hold each stage against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written to the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
