"""Deterministic keys: the same row gets the same key on any cluster layout.

Everything random in this library (samples, shuffles, folds) is an order over
``md5(seed:id)``. Unlike a seeded generator it depends neither on the number of
partitions nor on which task runs first, so a lost executor changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BUCKET_DIGITS = 4  # 16**4 buckets


def seeded_digest(row_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def digest_bucket(digest: Column, digits: int = BUCKET_DIGITS) -> Column:
    """Leading hex digits: buckets of equal expected size in digest order."""
    return F.substring(digest, 1, digits)


def unit_interval(digest: Column) -> Column:
    """The first 32 bits of the digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def row_digest(*columns: Column) -> Column:
    """md5 over all columns; null and every string stay distinguishable."""
    parts = [
        F.coalesce(
            F.concat(
                F.lit("V"),
                F.length(column.cast("string")).cast("string"),
                F.lit(":"),
                column.cast("string"),
            ),
            F.lit("N"),
        )
        for column in columns
    ]
    return F.md5(F.concat(*parts))
