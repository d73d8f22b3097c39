"""Row filters and the one-pass funnel that counts what each of them keeps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from labelwright import DOMAIN, MIN_CHARS
from labelwright.functions.numeric import nan_as_null, percent, round_half_even, valid_label
from labelwright.functions.text import not_blank, strip_text, text_length

Stage = tuple[str, Column]


def project_reviews(raw: DataFrame, *keep: str) -> DataFrame:
    """The review columns, typed and renamed; an unreadable rating or NaN is null."""
    return raw.select(
        *keep,
        F.col("text"),
        nan_as_null(F.col("rating").try_cast("double")).alias("rating"),
        F.col("asin"),
        F.col("user_id").alias("reviewerID"),
    )


def structural_stages(
    text_col: str = "text",
    label_col: str = "rating",
    domain: Sequence[float] = DOMAIN,
    min_chars: int = MIN_CHARS,
) -> list[Stage]:
    """The ingestion filters in order; length counts the untrimmed text."""
    text, label = F.col(text_col), F.col(label_col)
    return [
        ("text_present", text.isNotNull()),
        ("text_not_blank", not_blank(text)),
        ("text_long_enough", text_length(text) >= min_chars),
        ("label_present", label.isNotNull()),
        ("label_in_domain", label.isin(*domain)),
    ]


def structural_filter(df: DataFrame, **columns) -> DataFrame:
    return df.filter(_all(predicate for _, predicate in structural_stages(**columns)))


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def min_length(df: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Strip the text, then drop it if too short; null text is dropped too."""
    return df.withColumn(text_col, strip_text(F.col(text_col))).filter(
        text_length(F.col(text_col)) >= min_chars
    )


def keep_valid_labels(
    df: DataFrame,
    label_col: str = "rating",
    domain: Sequence[float] = DOMAIN,
    overwrite: bool = False,
) -> DataFrame:
    """Keep labels within 1e-9 of a domain value; optionally store that value."""
    kept = df.filter(valid_label(F.col(label_col), domain))
    return kept.withColumn(label_col, round_half_even(F.col(label_col))) if overwrite else kept


def split_by_flag(df: DataFrame, flag_col: str) -> tuple[DataFrame, DataFrame]:
    """(flagged, unflagged); a null flag counts as unflagged."""
    flag = F.coalesce(F.col(flag_col), F.lit(False))
    return df.filter(flag), df.filter(~flag)


def filter_funnel(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Rows left after each stage, in one pass over ``df``.

    Columns: step, stage, kept, dropped (by this stage), pct_of_raw.
    """
    counts = [F.count(F.lit(1)).alias("_n0")]
    for position in range(1, len(stages) + 1):
        passed = _all(predicate for _, predicate in stages[:position])
        counts.append(F.count_if(F.coalesce(passed, F.lit(False))).alias(f"_n{position}"))
    names = ["raw", *(name for name, _ in stages)]
    return funnel_rows(df.agg(*counts), names)


def funnel_rows(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Turn one row of counts _n0, _n1, … into one row per stage."""
    rows = [
        F.struct(
            F.lit(position).alias("step"),
            F.lit(name).alias("stage"),
            F.col(f"_n{position}").alias("kept"),
            (F.col(f"_n{max(position - 1, 0)}") - F.col(f"_n{position}")).alias("dropped"),
            percent(F.col(f"_n{position}"), F.col("_n0")).alias("pct_of_raw"),
        )
        for position, name in enumerate(names)
    ]
    return counts.select(F.inline(F.array(*rows)))


def _all(predicates) -> Column:
    return reduce(lambda left, right: left & right, predicates)
