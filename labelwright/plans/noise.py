"""Step 3: probably wrong labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from labelwright import DOMAIN, SEED
from labelwright.models.folds import oof_probabilities
from labelwright.operators.confident import (
    FRAC_NOISE,
    argmax_label,
    find_label_issues,
    label_decode,
    label_quality,
)
from labelwright.operators.filters import split_by_flag
from labelwright.operators.sampling import split_per_class
from labelwright.session import spool

MAX_PER_CLASS = 3000


def score_labels(
    probabilities: DataFrame,
    id_col: str,
    classes: Sequence[float] = DOMAIN,
    frac_noise: float = FRAC_NOISE,
) -> DataFrame:
    """Add quality score, issue flag and suggested rating to scored rows.

    ``probabilities`` has label_index and p; pass a table, it is read several
    times.
    """
    p = F.col("p")
    return find_label_issues(
        probabilities, len(classes), id_col, frac_noise=frac_noise
    ).select(
        *[name for name in probabilities.columns if name not in ("p", "label_index", "fold")],
        label_quality(p, F.col("label_index")).alias("label_quality_score"),
        "is_label_issue",
        label_decode(classes, argmax_label(p)).alias("suggested_rating"),
    )


def detect_noise(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    label_col: str = "rating",
    classes: Sequence[float] = DOMAIN,
    max_per_class: int | None = MAX_PER_CLASS,
    frac_noise: float = FRAC_NOISE,
    seed: str = SEED,
    **training,
) -> DataFrame:
    """Score every row by models that did not see it, flag the suspects.

    The models are fitted on at most ``max_per_class`` rows of each class, out of
    fold. Rows beyond that are scored too, by the mean of the models: none is lost.
    """
    rows = spool(df.na.drop(subset=[text_col, label_col]), "rated")
    fitted, others = rows, None
    if max_per_class:
        chosen, others = split_per_class(rows, max_per_class, id_col, label_col, seed)
        fitted = spool(chosen, "fitted")
    scored = oof_probabilities(
        fitted, id_col, text_col, label_col, classes, seed=seed, others=others, **training
    )
    return score_labels(scored, id_col, classes, frac_noise)


def noise_split(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(noisy, clean)."""
    return split_by_flag(scored, "is_label_issue")
