"""Gold table: ids, metadata, balance and provenance figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelwright import SEED
from labelwright.contracts import with_defaults
from labelwright.functions.numeric import percent
from labelwright.operators.filters import min_length
from labelwright.operators.joins import metadata_enrich
from labelwright.operators.position import seeded_position, shuffle_rows
from labelwright.operators.profile import class_counts
from labelwright.operators.relabel import UNKNOWN_SOURCE

POSITION_SEED = "position"


def sample_id(position: Column) -> Column:
    """GOLD_ and at least six digits."""
    return F.format_string("GOLD_%06d", position)


def with_sample_id(df: DataFrame, id_col: str, seed: str = POSITION_SEED) -> DataFrame:
    return seeded_position(df, id_col, seed, "_at").select(
        *df.columns, sample_id(F.col("_at")).alias("sample_id")
    )


def assemble_gold(
    curated: DataFrame,
    id_col: str,
    metadata: DataFrame | None = None,
    metadata_id_col: str | None = None,
    text_col: str = "text",
    label_col: str = "rating",
    seed: str = SEED,
    shuffle: bool = True,
) -> DataFrame:
    """Strip, filter, number, enrich and shuffle the curated rows."""
    rows = min_length(curated.na.drop(subset=[text_col, label_col]), text_col)
    rows = with_sample_id(with_defaults(rows, {"source": F.lit(UNKNOWN_SOURCE)}), id_col)
    if metadata is not None:
        rows = metadata_enrich(rows, metadata, id_col, metadata_id_col, text_col)
    return shuffle_rows(rows, id_col, seed) if shuffle else rows


def class_balance(df: DataFrame, label_col: str = "rating") -> DataFrame:
    """Entropy of the class shares over its maximum: 1 is even, 0 is one class."""
    counts = class_counts(df, label_col)
    total = counts.agg(F.sum("n")).scalar()
    share = F.col("n") / total
    sums = counts.agg(
        F.count(F.lit(1)).alias("n_classes"), (-F.sum(share * F.log(share + 1e-9))).alias("_h")
    )
    return sums.select(
        "n_classes",
        F.when(F.col("n_classes") <= 1, F.lit(0.0))
        .otherwise(F.col("_h") / F.log("n_classes"))
        .alias("balance_score"),
    )


def provenance_crosstab(
    df: DataFrame, label_col: str = "rating", source_col: str = "source"
) -> DataFrame:
    """(label, source, n, n_class, pct_class): class size and share of all rows."""
    cells = df.groupBy(label_col, source_col).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n")).scalar()
    classes = cells.groupBy(label_col).agg(
        F.collect_list(F.struct(source_col, "n")).alias("_cells"), F.sum("n").alias("n_class")
    )
    return classes.select(
        label_col, "n_class", percent(F.col("n_class"), total).alias("pct_class"), F.inline("_cells")
    ).select(label_col, source_col, "n", "n_class", "pct_class")


def metadata_coverage(df: DataFrame) -> DataFrame:
    """Rows matched by asin, and rows with and without a title."""
    count_present = lambda name: (
        F.count(F.col(name)) if name in df.columns else F.lit(0).cast("bigint")
    )
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("n_rows"),
        count_present("asin").alias("matched"),
        F.coalesce(percent(count_present("asin"), total), F.lit(0.0)).alias("matched_pct"),
        count_present("title").alias("with_title"),
        (total - count_present("title")).alias("without_title"),
    )


def assembly_report(gold: DataFrame, label_col: str = "rating") -> DataFrame:
    """The assembly figures as (section, key, detail, value)."""
    balance = class_balance(gold, label_col)
    coverage = metadata_coverage(gold)
    crosstab = provenance_crosstab(gold, label_col).select(
        F.lit("provenance").alias("section"),
        F.col(label_col).cast("string").alias("key"),
        F.col("source").alias("detail"),
        F.col("n").cast("double").alias("value"),
    )
    result = crosstab
    for section, frame in (("balance", balance), ("coverage", coverage)):
        entries = [
            F.struct(
                F.lit(section).alias("section"),
                F.lit(name).alias("key"),
                F.lit("").alias("detail"),
                F.col(name).cast("double").alias("value"),
            )
            for name in frame.columns
        ]
        result = result.unionByName(frame.select(F.inline(F.array(*entries))))
    return result
