"""Deterministic samples, each a plain filter over the wide rows.

``n`` rows of a class are the ``n`` smallest (digest, id) of that class. Only
ids and labels are needed to find the n-th smallest, the *cut*; the wide rows
are then filtered against one cut per class, without a shuffle or a sort.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelwright import SEED
from labelwright.functions.hashing import BUCKET_DIGITS, digest_bucket, seeded_digest, unit_interval
from labelwright.operators.profile import class_counts

#: A bucket of more rows is divided once more before its ids are counted.
EDGE_ROWS = 1_000_000


def stratified_sample(
    df: DataFrame,
    fractions: Mapping[float, float],
    id_col: str,
    label_col: str = "rating",
    seed: str = SEED,
) -> DataFrame:
    """Bernoulli sample with one fraction per class; other classes are dropped."""
    share = literal_map(fractions)
    drawn = unit_interval(seeded_digest(F.col(id_col), seed))
    return df.filter(drawn < F.try_element_at(share, F.col(label_col)))


def sample_per_class(
    df: DataFrame,
    quota: int | Mapping[float, int],
    id_col: str,
    label_col: str = "rating",
    seed: str = SEED,
) -> DataFrame:
    """``quota`` rows of every class, or all of a smaller class.

    ``quota`` is a number, or one number per class (other classes give no
    rows). Rows without a label or an id are dropped. Two narrow passes run at once
    to find the cuts; the result is a lazy filter.
    """
    return df.filter(in_sample(df, quota, id_col, label_col, seed))


def split_per_class(
    df: DataFrame,
    quota: int | Mapping[float, int],
    id_col: str,
    label_col: str = "rating",
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(the rows of ``sample_per_class``, all others): each row is in exactly one, whatever its id."""
    chosen = F.coalesce(in_sample(df, quota, id_col, label_col, seed), F.lit(False))
    return df.filter(chosen), df.filter(~chosen)


def in_sample(
    df: DataFrame, quota: int | Mapping[float, int], id_col: str, label_col: str, seed: str
) -> Column:
    """The condition that the rows of ``sample_per_class`` meet."""
    cuts = class_cuts(df, quota, id_col, label_col, seed)
    if not cuts:
        return F.lit(False)
    kinds = {name: df.schema[name].dataType for name in (id_col, label_col)}
    cut_of = F.create_map(
        *[
            entry
            for label, (digest, row_id) in cuts.items()
            for entry in (
                F.lit(label).cast(kinds[label_col]),
                F.struct(
                    F.lit(digest).alias("digest"), F.lit(row_id).cast(kinds[id_col]).alias("id")
                ),
            )
        ]
    )
    key = F.struct(seeded_digest(F.col(id_col), seed).alias("digest"), F.col(id_col).alias("id"))
    return (
        F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
        & (key <= F.try_element_at(cut_of, F.col(label_col)))
    )


def class_cuts(
    df: DataFrame,
    quota: int | Mapping[float, int],
    id_col: str,
    label_col: str,
    seed: str,
    edge_rows: int = EDGE_ROWS,
) -> dict:
    """Class -> (digest, id) of the last row to keep; one entry per class.

    1. Count rows per (class, digest bucket): at most 65,536 rows per class.
    2. Find the bucket in which the quota is reached; if it is large, the one of its own
       65,536 buckets.
    3. Count that bucket's rows by id and add up in id order. An id that fills the table
       is one number a task by then.
    """
    keys = df.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(label_col).alias("_label"),
        F.col(id_col).alias("_id"),
        seeded_digest(F.col(id_col), seed).alias("_digest"),
    )
    label = F.col("_label")
    if isinstance(quota, Mapping):
        if not quota:
            return {}
        wanted = F.coalesce(F.try_element_at(literal_map(quota), label), F.lit(0))
    else:
        wanted = F.lit(quota)
    def edges_by(key: Column) -> list:
        sizes = keys.groupBy("_label", key.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        return edge_buckets(sizes, "_label", wanted.cast("bigint")).collect()

    for digits in (BUCKET_DIGITS, 2 * BUCKET_DIGITS):
        bucket = digest_bucket(F.col("_digest"), digits)
        edges = edges_by(bucket)
        if not edges:
            return {}
        keys = keys.filter(bucket == F.try_element_at(literal_map({e._label: e._bucket for e in edges}), label))
        wanted = F.try_element_at(literal_map({e._label: e._room for e in edges}), label)
        if max(e._n for e in edges) <= edge_rows:
            break
    last = edges_by(F.struct(F.col("_digest").alias("digest"), F.col("_id").alias("id")))
    return {e._label: (e._bucket.digest, e._bucket.id) for e in last}


def literal_map(values: Mapping) -> Column:
    """A map column from a few driver-side values, one per class or class pair."""
    return F.create_map(*[F.lit(entry) for pair in values.items() for entry in pair])


def edge_buckets(sizes: DataFrame, group_col: str, quota: Column) -> DataFrame:
    """Per group: the bucket that reaches the quota, its size and the room left.

    ``sizes`` has (group, _bucket, _n). A group smaller than its quota ends in
    its last bucket with more room than rows; a group without quota is absent.
    """
    running = F.sum("_n").over(Window.partitionBy(group_col).orderBy("_bucket"))
    return (
        sizes.withColumn("_upto", running)
        .withColumn("_room", quota - (F.col("_upto") - F.col("_n")))
        .filter(F.col("_room") > 0)
        .groupBy(group_col)
        .agg(
            F.max(F.struct("_bucket", "_room", "_n")).alias("_last"),
        )
        .select(group_col, "_last.*")
    )


def cap_per_class(
    df: DataFrame, cap: int, id_col: str, label_col: str = "rating", seed: str = SEED
) -> DataFrame:
    return sample_per_class(df, cap, id_col, label_col, seed)


def matched_stratified(
    pool: DataFrame,
    target: DataFrame,
    id_col: str,
    label_col: str = "rating",
    seed: str = SEED,
) -> DataFrame:
    """Draw from ``pool`` as many rows of each class as ``target`` has."""
    wanted = {row[label_col]: row["n"] for row in class_counts(target, label_col).collect()}
    return sample_per_class(pool, wanted, id_col, label_col, seed)


def sample_n(df: DataFrame, n: int, id_col: str, seed: str = SEED) -> DataFrame:
    """Exactly ``n`` rows, or all if there are fewer."""
    return sample_per_class(df.withColumn("_all", F.lit(0)), n, id_col, "_all", seed).drop("_all")
