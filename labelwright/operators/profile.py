"""Profiling aggregates.

Text length and class statistics share one aggregate, the *cube*: one row per
(label, text length) with its row count. The rows are combined before the
shuffle and the cube is small whatever the data size, so medians and
percentiles are exact without moving any text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType

from labelwright.functions.numeric import nan_as_null, percent
from labelwright.functions.text import text_key, text_length
from labelwright.session import spool


def with_nan_as_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing in every profile figure."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({name: nan_as_null(F.col(name)) for name in floats}) if floats else df


def table_shape(df: DataFrame) -> DataFrame:
    """n_rows, n_cols and the column names."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_cols"),
        F.lit(",".join(df.columns)).alias("columns"),
    )


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage of every column, from one aggregate."""
    columns = list(columns or df.columns)
    nulls = [F.count_if(F.col(name).isNull()).alias(f"_{i}") for i, name in enumerate(columns)]
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.col(f"_{i}").alias("n_missing"),
            percent(F.col(f"_{i}"), F.col("_rows")).alias("pct_missing"),
        )
        for i, name in enumerate(columns)
    ]
    return with_nan_as_null(df).agg(F.count(F.lit(1)).alias("_rows"), *nulls).select(F.inline(F.array(*rows)))


def class_counts(df: DataFrame, label_col: str = "rating") -> DataFrame:
    """(label, n) for the labels that are present."""
    return with_nan_as_null(df).filter(F.col(label_col).isNotNull()).groupBy(label_col).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_distribution(df: DataFrame, label_col: str = "rating") -> DataFrame:
    """Count and percentage per class; the percentage is of all rows."""
    counts = with_nan_as_null(df).groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    # A window over the few class rows. With a subquery the null filter would be
    # pushed into one of two scans.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return (
        counts.withColumn("pct", percent(F.col("n"), total))
        .filter(F.col(label_col).isNotNull())
        .select(label_col, "n", "pct")
    )


def length_cube(df: DataFrame, text_col: str = "text", label_col: str = "rating") -> DataFrame:
    """(label, n_chars, n); missing text has a null length."""
    return with_nan_as_null(df).groupBy(
        F.col(label_col).alias("label"), text_length(F.col(text_col)).alias("n_chars")
    ).agg(F.count(F.lit(1)).alias("n"))


def length_stats_of(cube: DataFrame) -> DataFrame:
    """Mean, median, min, max and the 5th and 95th percentile over a cube.

    Percentiles interpolate linearly. ``percentile`` sees each length once,
    weighted by its count.
    """
    by_length = cube.filter(F.col("n_chars").isNotNull()).groupBy("n_chars").agg(
        F.sum("n").alias("n")
    )
    summary = by_length.agg(
        F.try_divide(
            F.sum((F.col("n_chars") * F.col("n")).cast("decimal(38,0)")).cast("double"),
            F.sum("n"),
        ).alias("mean_chars"),
        F.expr("percentile(n_chars, array(0.05D, 0.5D, 0.95D), n)").alias("_p"),
        F.min("n_chars").alias("min_chars"),
        F.max("n_chars").alias("max_chars"),
    )
    return summary.select(
        "mean_chars",
        F.col("_p")[1].alias("median_chars"),
        "min_chars",
        "max_chars",
        F.col("_p")[0].alias("p5_chars"),
        F.col("_p")[2].alias("p95_chars"),
    )


def text_length_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    return length_stats_of(length_cube(df.withColumn("_all", F.lit(0)), text_col, "_all"))


def duplicate_profile(
    df: DataFrame, text_col: str = "text", label_col: str = "rating"
) -> DataFrame:
    """Repeated rows and label conflicts, in one row.

    dup_text_label, dup_text: rows beyond the first of each group. conflict_texts,
    conflict_rows: texts that carry more than one label, and their rows.
    Both group-bys combine before the shuffle, so a text that fills a third of
    the table arrives as one row per task.
    """
    pairs = with_nan_as_null(df).groupBy(text_key(F.col(text_col)).alias("_key"), label_col).agg(
        F.count(F.lit(1)).alias("_n")
    )
    texts = pairs.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_pairs"),
        F.count(label_col).alias("_labels"),
        F.sum("_n").alias("_n"),
    )
    conflict = F.col("_key").isNotNull() & (F.col("_labels") > 1)
    return texts.agg(
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.coalesce(F.sum("_pairs"), F.lit(0))).alias(
            "dup_text_label"
        ),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("dup_text"),
        F.count_if(conflict).alias("conflict_texts"),
        F.coalesce(F.sum(F.when(conflict, F.col("_n"))), F.lit(0)).alias("conflict_rows"),
    )


def label_conflicts(df: DataFrame, text_col: str = "text", label_col: str = "rating") -> DataFrame:
    """One row per text that carries several labels, with its row and label count."""
    pairs = (
        with_nan_as_null(df)
        .filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(text_key(F.col(text_col)).alias("text_key"), label_col)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        pairs.groupBy("text_key")
        .agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_labels"))
        .filter("n_labels > 1")
        .withColumn("text_key", F.lower(F.hex("text_key")))
    )


def imbalance(df: DataFrame, label_col: str = "rating") -> DataFrame:
    """Majority and minority class (lowest label on ties) and their ratio."""
    return imbalance_of(class_counts(df, label_col), label_col)


def imbalance_of(counts: DataFrame, label_col: str) -> DataFrame:
    label, n = F.col(label_col), F.col("n")
    return counts.agg(
        F.max_by(label, F.struct(n, -label)).alias("majority"),
        F.min_by(label, F.struct(n, label)).alias("minority"),
        F.try_divide(F.max(n), F.min(n)).alias("imbalance_ratio"),
    )


def profile_dataset(
    df: DataFrame, text_col: str = "text", label_col: str = "rating"
) -> DataFrame:
    """Every profile figure as (metric, key, value): two scans of ``df``.

    The first scan feeds the cube and the null counts, the second the
    duplicates. The cube is small and written out, so that the parts below
    share it instead of each scanning ``df`` with its own filter.
    """
    nulls = [name for name in df.columns if name not in (text_col, label_col)]
    df = with_nan_as_null(df)
    cube = spool(
        df.groupBy(
            F.col(label_col).alias("label"), text_length(F.col(text_col)).alias("n_chars")
        ).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(F.col(name).isNull()).alias(f"_null_{i}") for i, name in enumerate(nulls)],
        ),
        "cube",
    )
    n = F.coalesce(F.sum("n"), F.lit(0))
    missing = {
        text_col: F.coalesce(F.sum(F.when(F.col("n_chars").isNull(), F.col("n"))), F.lit(0)),
        label_col: F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.lit(0)),
    } | {name: F.coalesce(F.sum(f"_null_{i}"), F.lit(0)) for i, name in enumerate(nulls)}
    totals = cube.agg(
        n.alias("_rows"), *[value.alias(f"_m{i}") for i, value in enumerate(missing.values())]
    ).select(
        _metrics(
            ("n_rows", "", F.col("_rows")),
            ("n_cols", "", F.lit(len(df.columns))),
            *[("missing", name, F.col(f"_m{i}")) for i, name in enumerate(missing)],
            *[
                ("missing_pct", name, percent(F.col(f"_m{i}"), F.col("_rows")))
                for i, name in enumerate(missing)
            ],
        )
    )
    by_class = cube.groupBy("label").agg(F.sum("n").alias("n"))
    rows = by_class.agg(F.sum("n")).scalar()
    classes = by_class.filter(F.col("label").isNotNull()).select(
        _metrics(
            ("class_count", F.col("label").cast("string"), F.col("n")),
            ("class_pct", F.col("label").cast("string"), percent(F.col("n"), rows)),
        )
    )
    lengths = length_stats_of(cube)
    ratio = imbalance_of(by_class.filter(F.col("label").isNotNull()), "label")
    duplicates = duplicate_profile(df, text_col, label_col)
    wide = [
        frame.select(_metrics(*[(name, "", F.col(name)) for name in frame.columns]))
        for frame in (lengths, ratio, duplicates)
    ]
    result = totals.unionByName(classes)
    for frame in wide:
        result = result.unionByName(frame)
    return result


def _metrics(*triples):
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(metric).alias("metric"),
                    (key if not isinstance(key, str) else F.lit(key)).alias("key"),
                    value.cast("double").alias("value"),
                )
                for metric, key, value in triples
            ]
        )
    )
