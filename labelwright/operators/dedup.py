"""Exact duplicates and row identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from labelwright.functions.hashing import row_digest
from labelwright.functions.text import strip_text


def first_per_key(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Keep the row with the smallest id of each key; nulls are equal keys.

    ``row_number() = 1`` becomes a group limit in every task before the
    shuffle: a key with a third of all rows sends one row per task. Sorting
    starts on the 64-bit hash, and texts are compared only where hashes meet.
    """
    long_keys = [name for name in keys if isinstance(df.schema[name].dataType, StringType)]
    hashes = [F.xxhash64(*long_keys)] if long_keys else []
    window = Window.partitionBy(*hashes, *keys).orderBy(id_col)
    return df.withColumn("_place", F.row_number().over(window)).filter("_place = 1").drop("_place")


def dedup_text_label(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    label_col: str = "rating",
    after_strip: bool = False,
) -> DataFrame:
    """Drop repeats of (text, label), by default before any stripping."""
    if after_strip:
        df = df.withColumn(text_col, strip_text(F.col(text_col)))
    return first_per_key(df, [text_col, label_col], id_col)


def dedup_text(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    return first_per_key(df, [text_col], id_col)


def assign_row_id(df: DataFrame, id_col: str = "row_id", copies_per_task: int = 100_000) -> DataFrame:
    """Give rows without an id one: digest of all columns plus copy number.

    Equal rows cannot be told apart, so they are counted (combined before the
    shuffle) and written out again with numbers 1..n. The copies of one row are
    spread over tasks in runs of ``copies_per_task``.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    last_run = F.floor((F.col("_copies") - 1) / F.lit(copies_per_task))
    runs = counted.withColumn("_digest", row_digest(*[F.col(name) for name in columns])).withColumn(
        "_run", F.explode(F.sequence(F.lit(0).cast("bigint"), last_run))
    )
    first = F.col("_run") * copies_per_task + 1
    last = F.least(F.col("_copies"), (F.col("_run") + 1) * copies_per_task)
    spread = runs.repartition("_digest", "_run")
    return spread.withColumn("_copy", F.explode(F.sequence(first, last))).select(
        F.concat_ws("-", "_digest", F.col("_copy").cast("string")).alias(id_col), *columns
    )
