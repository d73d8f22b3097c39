"""Joins on text. Texts repeat, and one text may fill a third of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from labelwright.contracts import METADATA_COLUMNS, present_columns
from labelwright.functions.hashing import seeded_digest, unit_interval
from labelwright.functions.text import text_key
from labelwright.operators.dedup import dedup_text
from labelwright.session import spool

HOT_SHARE = 1e-5
SAMPLE_RATE = 1 / 64
MIN_HITS = 20
FILTER_BUCKETS = 1 << 20


def hot_keys(
    df: DataFrame,
    key_col: str,
    id_col: str,
    share: float = HOT_SHARE,
    rate: float = SAMPLE_RATE,
    min_hits: int = MIN_HITS,
) -> DataFrame:
    """(key, _salts) of keys that hold more than ``share`` of the rows.

    Keys are counted on a sample drawn by id. ``_salts`` is the number of parts
    in which no part exceeds ``share``. At most ``1 / share`` keys can qualify and
    their parts add up to at most ``2 / share``, so the table is small by
    construction. The sample decides how rows are spread, never which rows match.
    """
    drawn = unit_interval(seeded_digest(F.col(id_col), "hot")) < rate
    counted = (
        df.filter(drawn & F.col(key_col).isNotNull())
        .groupBy(key_col)
        .agg(F.count(F.lit(1)).alias("_hits"))
    )
    part = counted.agg(F.sum("_hits")).scalar() * F.lit(share)
    return counted.filter((F.col("_hits") >= min_hits) & (F.col("_hits") > part)).select(
        key_col, F.ceil(F.col("_hits") / part).alias("_salts")
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key_col: str,
    id_col: str,
    how: str,
    share: float = HOT_SHARE,
    rate: float = SAMPLE_RATE,
    min_hits: int = MIN_HITS,
) -> DataFrame:
    """``left`` or ``left_anti`` equi-join that spreads hot and null keys.

    Left rows of a hot key are split into its parts by id; the right rows of
    that key, and only those, are repeated once per part.
    """
    if how not in ("left", "left_anti"):
        raise ValueError("how must be 'left' or 'left_anti'")
    hot = F.broadcast(hot_keys(left, key_col, id_col, share, rate, min_hits))
    parts = F.when(F.col(key_col).isNull(), F.lit(int(1 / share))).otherwise(
        F.coalesce("_salts", F.lit(1))
    )
    salted_left = (
        left.join(hot, key_col, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(id_col), parts))
        .drop("_salts")
    )
    salted_right = (
        right.join(hot, key_col, "left")
        .withColumn(
            "_salt",
            F.explode(
                F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)) - 1)
            ),
        )
        .drop("_salts")
    )
    return salted_left.join(salted_right, [key_col, "_salt"], how).drop("_salt")


def split_by_bucket(
    df: DataFrame, keys: DataFrame, key_col: str, buckets: int = FILTER_BUCKETS
) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose key may be in ``keys``, rows whose key is not), without a shuffle.

    Only the numbers of the buckets that hold a key are broadcast: at most ``buckets``,
    whatever the size of ``keys``. Every row of ``df`` is in exactly one of the two; null
    keys are in the second.
    """
    bucket = F.when(
        F.col(key_col).isNotNull(), F.pmod(F.xxhash64(key_col), F.lit(buckets)).cast("int")
    )
    taken = F.broadcast(
        keys.filter(F.col(key_col).isNotNull()).select(bucket.alias("_bucket")).distinct()
    )
    marked = df.withColumn("_bucket", bucket)
    return (
        marked.join(taken, "_bucket", "left_semi").drop("_bucket"),
        marked.join(taken, "_bucket", "left_anti").drop("_bucket"),
    )


def metadata_enrich(
    df: DataFrame,
    metadata: DataFrame,
    id_col: str,
    metadata_id_col: str,
    text_col: str = "text",
    columns: Sequence[str] = METADATA_COLUMNS,
) -> DataFrame:
    """Add product columns by exact text; the first metadata row of a text wins.

    Returns ``df`` unchanged unless the metadata have ``asin`` and one more
    column.
    """
    found = present_columns(metadata, columns)
    if "asin" not in found or len(found) < 2:
        return df
    lookup = dedup_text(
        metadata.filter(F.col(text_col).isNotNull()).select(metadata_id_col, text_col, *found),
        metadata_id_col,
        text_col,
    ).select(text_key(F.col(text_col)).alias("_key"), *found)
    keyed = df.drop(*found).withColumn("_key", text_key(F.col(text_col)))
    kept = [name for name in df.columns if name not in found]
    return salted_join(keyed, lookup, "_key", id_col, "left").select(*kept, *found)


def remove_leakage(
    train: DataFrame,
    test: DataFrame,
    id_col: str,
    text_col: str = "text",
    buckets: int = FILTER_BUCKETS,
) -> DataFrame:
    """Drop training rows whose text is in the test set; null texts stay.

    One plan for every size of the test set: its buckets travel to every task, training
    rows in other buckets pass without a shuffle, and the rest, written once, take the
    exact join. With 1,000 test texts that is one training row in a thousand.
    """
    columns = train.columns
    keyed = train.withColumn("_key", text_key(F.col(text_col)))
    keys = spool(
        test.filter(F.col(text_col).isNotNull())
        .select(text_key(F.col(text_col)).alias("_key"))
        .distinct(),
        "test_keys",
    )
    likely, others = split_by_bucket(keyed, keys, "_key", buckets)
    kept = salted_join(spool(likely, "likely"), keys, "_key", id_col, "left_anti")
    return others.unionByName(kept.select(*others.columns)).select(*columns)


def resume_anti(df: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not in ``done``; ids are unique, so nothing is hot."""
    return df.join(done.select(id_col), id_col, "left_anti").select(*df.columns)


def flag_join(df: DataFrame, flags: DataFrame, id_col: str, flag_col: str) -> DataFrame:
    """Attach a flag by id; rows without one get False."""
    return (
        df.join(flags.select(id_col, flag_col), id_col, "left")
        .withColumn(flag_col, F.coalesce(F.col(flag_col), F.lit(False)))
        .select(*df.columns, flag_col)
    )
