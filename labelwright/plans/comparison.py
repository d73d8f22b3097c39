"""Step 6: what each curation step contributes, on one shared test set."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from labelwright import DOMAIN, SEED
from labelwright.models.classifier import evaluate_all
from labelwright.operators.dedup import dedup_text, dedup_text_label
from labelwright.operators.joins import remove_leakage
from labelwright.operators.metrics import effect_decomposition
from labelwright.operators.position import shuffle_rows
from labelwright.operators.profile import class_counts
from labelwright.operators.sampling import matched_stratified, sample_per_class
from labelwright.session import spool

TEST_PER_CLASS = 200
VARIANTS = ("V0_with_duplicates", "V1_full", "V1_matched", "V1_corrected")
EFFECTS = ("deduplication", "class_balance", "label_correction")


def fixed_test_set(
    clean: DataFrame,
    id_col: str,
    text_col: str = "text",
    label_col: str = "rating",
    per_class: int = TEST_PER_CLASS,
    seed: str = SEED,
    shuffle: bool = True,
) -> DataFrame:
    """Up to ``per_class`` rows of each class, then one row per text.

    Duplicates go after sampling, so a class may end below ``per_class``.
    """
    sampled = sample_per_class(clean, per_class, id_col, label_col, seed)
    unique = dedup_text(sampled.select(id_col, text_col, label_col), id_col, text_col)
    return shuffle_rows(unique, id_col, seed) if shuffle else unique


def shortfall(
    clean: DataFrame, label_col: str = "rating", per_class: int = TEST_PER_CLASS
) -> DataFrame:
    """Classes with fewer than ``per_class`` rows to draw from."""
    return class_counts(clean, label_col).select(
        label_col,
        F.col("n").alias("available"),
        F.greatest(F.lit(per_class) - F.col("n"), F.lit(0)).alias("short_by"),
    )


def build_variants(
    raw: DataFrame,
    sanitized: DataFrame,
    gold: DataFrame,
    test: DataFrame,
    id_col: str,
    text_col: str = "text",
    label_col: str = "rating",
    seed: str = SEED,
) -> dict[str, DataFrame]:
    """The four training sets, none of which holds a text of the test set.

    Pass stored tables: the matched draw reads its pool three times.
    """
    columns = [id_col, text_col, label_col]
    test = spool(test, "test_set")
    with_duplicates, full, corrected = (
        remove_leakage(frame.select(*columns), test, id_col, text_col)
        for frame in (raw, sanitized, gold)
    )
    matched = matched_stratified(full, corrected, id_col, label_col, seed)
    return dict(zip(VARIANTS, (with_duplicates, full, matched, corrected)))


def variant_sizes(variants: dict[str, DataFrame]) -> DataFrame:
    """(variant, n, diff_from_first)."""
    sizes = reduce(
        DataFrame.unionByName,
        [
            frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("variant"), "n")
            for name, frame in variants.items()
        ],
    )
    first = sizes.filter(F.col("variant") == next(iter(variants))).select("n").scalar()
    return sizes.withColumn("diff_from_first", first - F.col("n"))


def compare_variants(
    variants: dict[str, DataFrame],
    test: DataFrame,
    id_col: str,
    text_col: str = "text",
    label_col: str = "rating",
    classes: Sequence[float] = DOMAIN,
    model_path: str | None = None,
    **training,
) -> DataFrame:
    """One result row per variant; the model of the last one is saved.

    All variants are trained by the same passes over their stored features.
    """
    results = evaluate_all(
        variants, spool(test, "test_set"), id_col, text_col, label_col, classes, model_path, **training
    )
    return spool(reduce(DataFrame.unionByName, [row for row, _ in results.values()]), "comparison")


def effects(results: DataFrame) -> DataFrame:
    return effect_decomposition(results, VARIANTS, EFFECTS)


def comparison_report(results: DataFrame) -> DataFrame:
    """(section, item, metric, value): every score of every variant, and what each step contributes.

    Long and small, for ``report_sink``.
    """
    scores = [name for name in results.columns if name != "experiment"]
    long = results.unpivot("experiment", [F.col(name).cast("double").alias(name) for name in scores], "metric", "value")
    steps = effects(results).unpivot("effect", ["delta_f1", "delta_pct"], "metric", "value")
    return long.select(F.lit("variant").alias("section"), F.col("experiment").alias("item"), "metric", "value").unionByName(
        steps.select(F.lit("effect").alias("section"), F.col("effect").alias("item"), "metric", "value")
    )
