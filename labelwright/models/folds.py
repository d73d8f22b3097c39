"""Out-of-fold class probabilities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from labelwright import DOMAIN, SEED
from labelwright.models.linear import LOGISTIC, TOLERANCE, Shape, fit, pack, probabilities
from labelwright.models.stages import WORKING_COLUMNS, TfidfVectorizer, spread_small
from labelwright.operators.confident import label_encode
from labelwright.operators.features import MAX_FEATURES, MIN_DOCS
from labelwright.operators.position import seeded_position
from labelwright.operators.profile import class_counts
from labelwright.session import spool

FOLDS = 5


def assign_folds(
    df: DataFrame,
    id_col: str,
    label_col: str = "rating",
    folds: int = FOLDS,
    seed: str = SEED,
    out: str = "fold",
) -> DataFrame:
    """Stratified folds: each class, in digest order, cut into equal runs.

    The first ``n mod folds`` runs of a class have one row more.
    """
    placed = seeded_position(
        df.filter(F.col(label_col).isNotNull()), id_col, seed, "_at", [label_col]
    )
    size_of = class_counts(df, label_col).agg(
        F.map_from_entries(F.collect_list(F.struct(label_col, "n")))
    ).scalar()
    n = F.try_element_at(size_of, F.col(label_col))
    short = F.floor(n / folds)
    longer = n % folds
    border = longer * (short + 1)
    fold = F.when(F.col("_at") < border, F.floor(F.col("_at") / (short + 1))).otherwise(
        longer + F.floor((F.col("_at") - border) / F.greatest(short, F.lit(1)))
    )
    return placed.withColumn(out, fold.cast("int")).drop("_at")


def oof_probabilities(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    label_col: str = "rating",
    classes: Sequence[float] = DOMAIN,
    folds: int = FOLDS,
    inverse_penalty: float = 0.5,
    max_iter: int = 1000,
    max_features: int = MAX_FEATURES,
    min_docs: int = MIN_DOCS,
    seed: str = SEED,
    others: DataFrame | None = None,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Each row scored by models that did not see it: label_index, fold, p.

    ``others``: rows with the columns of ``df`` to score besides. No model sees
    them, so their p is the mean over the models of all folds and their fold is null.
    Rows whose label is none of ``classes`` are left out.

    The vectoriser is fitted on all rows, the logistic regressions on the other folds:
    |w|^2/2 + C * sum of log losses, intercept free, to ``tolerance``. Features and result
    are written once each. Every pass over the stored features takes the gradients of all
    folds, and nothing later repeats a fit.
    """
    vectorizer = TfidfVectorizer(id_col, text_col, 1, max_features, min_docs)
    placed = spool(
        assign_folds(
            df.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()),
            id_col, label_col, folds, seed,
        ),
        "folds",
    )
    n_rows = placed.count()
    labelled = spread_small(placed, id_col, n_rows)
    vectors = vectorizer.fit(labelled)
    features = spool(
        vectors.transform(labelled)
        .withColumn("label_index", label_encode(classes, F.col(label_col)))
        .filter(F.col("label_index").isNotNull())
        .drop(*WORKING_COLUMNS),
        "features",
    )
    # Folds are numbered from 0; a model is trained on every fold but its own.
    numbers = sorted(row.fold for row in features.select("fold").distinct().collect())
    others_of = F.filter(F.lit(numbers), lambda fold: fold != F.col("fold"))
    trained = features.select(
        "features", F.col("label_index").alias("target"),
        F.transform(others_of, lambda fold: F.array_position(F.lit(numbers), fold).cast("int") - 1).alias("models"),
    )
    shape = Shape(
        LOGISTIC, max(len(numbers), 1), len(classes), len(vectors.stages[1].vocabulary), inverse_penalty
    )
    weights, _ = fit(pack(trained, shape.n_models), shape, max_iter, tolerance)
    models = [weights[:, at:at + shape.outputs] for at in range(0, weights.shape[1], shape.outputs)]
    own = reduce(
        lambda chain, at: chain.when(
            F.col("fold") == numbers[at], probabilities(F.col("features"), models[at], len(classes))
        ),
        range(len(numbers)), F.when(F.lit(False), F.lit(None)),
    )
    scored = features.select(*df.columns, "fold", "label_index", own.alias("p"))
    if others is not None:
        unseen = vectors.transform(others).withColumn("label_index", label_encode(classes, F.col(label_col)))
        each = [probabilities(F.col("features"), model, len(classes)) for model in models]
        total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), each)
        scored = scored.unionByName(
            unseen.filter(F.col("label_index").isNotNull()).select(
                *df.columns, F.lit(None).cast("int").alias("fold"), "label_index",
                F.transform(total, lambda x: x / F.lit(float(len(models)))).alias("p"),
            )
        )
    return spool(scored, "out_of_fold")
