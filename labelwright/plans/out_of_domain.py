"""A clean test set from another domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from labelwright import DOMAIN, MIN_CHARS, SEED
from labelwright.contracts import first_present
from labelwright.functions.literals import extract_overall
from labelwright.functions.numeric import valid_label
from labelwright.functions.text import strip_text, text_length
from labelwright.operators.dedup import dedup_text
from labelwright.operators.filters import funnel_rows, keep_valid_labels, min_length
from labelwright.operators.sampling import sample_n
from labelwright.session import spool

FUNNEL = ("raw", "not_missing", "text_long_enough", "unique_text", "label_valid", "sampled")


def _steps(hotels: DataFrame, id_col: str, ratings_col: str) -> tuple[DataFrame, DataFrame]:
    """(all rows with text and rating, one stripped row per text)."""
    extracted = hotels.select(
        id_col,
        first_present(hotels, ["text", "title"]).alias("text"),
        extract_overall(F.col(ratings_col)).alias("rating"),
    )
    long_enough = min_length(extracted.na.drop(subset=["text", "rating"]), "text")
    # Before the rating is checked: a bad first row hides a good later copy.
    return extracted, dedup_text(long_enough, id_col, "text")


def prepare_ood(
    hotels: DataFrame,
    id_col: str,
    ratings_col: str = "ratings",
    n: int | None = None,
    domain: Sequence[float] = DOMAIN,
    seed: str = SEED,
) -> DataFrame:
    """(id, text, rating): the rows that pass every check; a sample of ``n`` of them if asked for."""
    _, unique = _steps(hotels, id_col, ratings_col)
    valid = keep_valid_labels(unique, "rating", domain, overwrite=True)
    if n is None:
        return valid
    # Written once, because the sample reads it three times.
    return sample_n(spool(valid, "ood"), n, id_col, seed)


def ood_funnel(
    hotels: DataFrame,
    id_col: str,
    ratings_col: str = "ratings",
    n: int | None = None,
    domain: Sequence[float] = DOMAIN,
) -> DataFrame:
    """Rows left after each check: one aggregate before dedup, one after."""
    extracted, unique = _steps(hotels, id_col, ratings_col)
    present = F.col("text").isNotNull() & F.col("rating").isNotNull()
    long_enough = text_length(strip_text(F.col("text"))) >= MIN_CHARS
    before = extracted.agg(
        F.count(F.lit(1)).alias("_n0"),
        F.count_if(present).alias("_n1"),
        F.count_if(present & long_enough).alias("_n2"),
    )
    after = unique.agg(
        F.struct(
            F.count(F.lit(1)).alias("unique"),
            F.count_if(valid_label(F.col("rating"), domain)).alias("valid"),
        ).alias("n")
    ).scalar()
    counts = before.select(
        "_n0",
        "_n1",
        "_n2",
        after["unique"].alias("_n3"),
        after["valid"].alias("_n4"),
        (after["valid"] if n is None else F.least(after["valid"], F.lit(n))).alias("_n5"),
    )
    return funnel_rows(counts, FUNNEL)
