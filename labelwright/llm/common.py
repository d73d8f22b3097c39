"""What several operators share: tables, words, and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Words are maximal runs of anything but the six ASCII blanks.
BLANK = r"\x20\x09-\x0D"
WORD = f"[^{BLANK}]+"

MAX_SLICE_BYTES = 8 << 20
MAX_SLICE_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column of the input has it (in any case)."""
    lowered = {name.lower() for name in taken}
    while wanted.lower() in lowered:
        wanted = f"_{wanted}"
    return wanted


def small_slices(
    batches: Iterator[pa.RecordBatch], text_column: str, max_bytes: int = MAX_SLICE_BYTES,
    max_rows: int = MAX_SLICE_ROWS,
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices of about ``max_bytes`` of text at most.

    A single text above the bound is a slice of its own: texts are never cut.
    """
    for batch in batches:
        sizes = pa.compute.fill_null(
            pa.compute.binary_length(batch.column(text_column)), 0
        ).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if row > start and (held + size > max_bytes or row - start >= max_rows):
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def give_back() -> None:
    """Hands freed memory to the system at the end of a task: its worker stays for others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


#: Keys of a filter by bucket: a table of at most this many rows, so it may be broadcast.
FILTER_BUCKETS = 1 << 20


def likely_in(rows: DataFrame, key: Column, needed: DataFrame, needed_key: Column) -> DataFrame:
    """The rows whose ``key`` may be among ``needed``, and some others.

    Saves a shuffle of rows that an equi-join would drop. What is broadcast are the
    needed keys' buckets, ``FILTER_BUCKETS`` at most however many keys there are; with
    very many, all rows pass, and the join after it is as exact as without.
    """
    name = free_name(rows.columns, "_bucket")
    buckets = needed.select(F.pmod(needed_key, F.lit(FILTER_BUCKETS)).cast("int").alias(name)).distinct()
    return rows.withColumn(name, F.pmod(key, F.lit(FILTER_BUCKETS)).cast("int")).join(
        F.broadcast(buckets), name, "left_semi"
    ).drop(name)
