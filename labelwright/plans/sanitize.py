"""Step 2: exact duplicates and short texts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelwright import MIN_CHARS
from labelwright.functions.text import strip_text, text_key, text_length
from labelwright.operators.dedup import dedup_text_label
from labelwright.operators.filters import funnel_rows, min_length


def sanitize(
    df: DataFrame, id_col: str, text_col: str = "text", label_col: str = "rating",
    dedup_after_strip: bool = False,
) -> DataFrame:
    """Dedup on the text as it is, then strip and drop short texts.

    Rows that become equal only by stripping stay, unless ``dedup_after_strip``.
    """
    unique = dedup_text_label(df, id_col, text_col, label_col, dedup_after_strip)
    return min_length(unique, text_col)


def sanitize_funnel(
    df: DataFrame, id_col: str, text_col: str = "text", label_col: str = "rating"
) -> DataFrame:
    """Rows before, after dedup and after the length filter; one pass.

    Counts come from (text digest, label) groups, so no text is shuffled.
    """
    groups = df.groupBy(text_key(F.col(text_col)).alias("_key"), label_col).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(text_length(strip_text(F.col(text_col)))).alias("_chars"),
    )
    counts = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_n0"),
        F.count(F.lit(1)).alias("_n1"),
        F.count_if(F.col("_chars") >= MIN_CHARS).alias("_n2"),
    )
    return funnel_rows(counts, ["raw", "unique_text_label", "text_long_enough"])
