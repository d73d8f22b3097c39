"""Global positions without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelwright import SEED
from labelwright.functions.hashing import digest_bucket, seeded_digest
from labelwright.session import spool

_ROWS_BEFORE = (Window.unboundedPreceding, -1)


def seeded_position(
    df: DataFrame,
    id_col: str,
    seed: str = SEED,
    out: str = "position",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """0-based place of each row in digest order, within its group if any.

    Place = rows in the earlier buckets of the group + place inside the bucket.
    Buckets are digest prefixes, so they have equal expected size however
    skewed the groups are. The window and the join use the same keys: one
    shuffle. Group columns must not be null.
    """
    keys = [*group_cols, "_bucket"]
    keyed = df.withColumn("_digest", seeded_digest(F.col(id_col), seed)).withColumn(
        "_bucket", digest_bucket(F.col("_digest"))
    )
    before = Window.partitionBy(*(group_cols or [F.lit(0)])).orderBy("_bucket").rowsBetween(
        *_ROWS_BEFORE
    )
    offsets = (
        keyed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys).orderBy("_digest", id_col)
    return (
        keyed.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(out, F.col("_offset") + F.col("_inside") - 1)
        .drop("_digest", "_bucket", "_inside", "_offset")
        .select(*df.columns, out)
    )


def ordered_position(
    df: DataFrame, order: Sequence[Column | str], out: str = "position"
) -> DataFrame:
    """0-based place of each row in any total order.

    A range-partitioned sort, written to the shared folder with each row's slot
    (partition, place). The partition sizes then give the offsets; there are at
    most as many as ``spark.sql.shuffle.partitions``, so they are broadcast.
    """
    return numbered(df.orderBy(*order), out)


def numbered(df: DataFrame, out: str = "position") -> DataFrame:
    """0-based place of each row in the order in which ``df`` comes."""
    placed = spool(df.withColumn("_slot", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_slot", 33)
    inside = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(*_ROWS_BEFORE)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + inside)
        .select(*df.columns, out)
    )


def rank_within(
    df: DataFrame, group_col: str, order: Sequence[Column | str], out: str = "rank"
) -> DataFrame:
    """1-based rank inside each group, for groups too large for one task.

    Global place minus the place where the group starts. ``group_col`` must
    have few distinct values (classes, pairs of classes).
    """
    placed = ordered_position(df, [group_col, *order], "_at")
    starts = placed.groupBy(group_col).agg(F.min("_at").alias("_start"))
    start_of = starts.agg(
        F.map_from_entries(F.collect_list(F.struct(group_col, "_start")))
    ).scalar()
    return placed.withColumn(
        out, F.col("_at") - F.try_element_at(start_of, F.col(group_col)) + 1
    ).drop("_at")


def shuffle_rows(df: DataFrame, id_col: str, seed: str = SEED) -> DataFrame:
    """A seeded permutation of all rows, as a range-partitioned sort."""
    return df.orderBy(seeded_digest(F.col(id_col), seed), id_col)


def batch_rows(df: DataFrame, id_col: str, size: int = 5, seed: str = SEED) -> DataFrame:
    """Groups of ``size`` neighbours in digest order: batch_id and item_no."""
    placed = seeded_position(df, id_col, seed, "_at")
    return placed.select(
        *df.columns,
        F.floor(F.col("_at") / size).alias("batch_id"),
        (F.col("_at") % size).cast("int").alias("item_no"),
    )
