"""Confident learning on class probabilities (Northcutt, Jiang and Chuang,
"Confident Learning: Estimating Uncertainty in Dataset Labels", JAIR 70, 2021),
pruning by noise rate.

Input: one row per document with its class index (0..K-1) and an array of K
probabilities. Spark reduces the rows to statistics of K or K*K numbers; these
go back into the row expressions as literals. Flagging a row then looks only at
the row itself.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelwright.operators.position import ordered_position, rank_within
from labelwright.operators.sampling import edge_buckets, literal_map

FRAC_NOISE = 0.05
WINDOW_ROWS = 1_000_000
_MARGIN_BUCKETS = 1 << 16


def label_classes(df: DataFrame, label_col: str = "rating") -> Column:
    """The sorted distinct labels, as an array column."""
    return df.select(label_col).agg(F.sort_array(F.collect_set(label_col))).scalar()


def class_array(classes: Sequence[float] | Column) -> Column:
    if isinstance(classes, Column):
        return classes
    return F.array(*[F.lit(value) for value in sorted(classes)])


def label_encode(classes: Sequence[float] | Column, label: Column) -> Column:
    """0-based index of the label among the sorted classes; null if unknown."""
    index = F.array_position(class_array(classes), label).cast("int")
    return F.when(index > 0, index - 1)


def label_decode(classes: Sequence[float] | Column, index: Column) -> Column:
    return F.try_element_at(class_array(classes), index + 1)


def argmax_label(probabilities: Column) -> Column:
    """0-based index of the first largest probability."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def label_quality(probabilities: Column, index: Column) -> Column:
    """Self-confidence: the probability of the given label."""
    return F.try_element_at(probabilities, index + 1)


def class_thresholds(df: DataFrame, index_col: str = "label_index", p_col: str = "p") -> DataFrame:
    """(index, threshold, n): mean self-confidence of each class."""
    return df.filter(F.col(index_col).isNotNull()).groupBy(index_col).agg(
        F.avg(label_quality(F.col(p_col), F.col(index_col))).alias("threshold"),
        F.count(F.lit(1)).alias("n"),
    )


def with_confident_class(
    df: DataFrame,
    thresholds: Mapping[int, float],
    p_col: str = "p",
    out: str = "confident",
) -> DataFrame:
    """Add the most probable class among those at or above their threshold.

    Null where no class reaches its threshold.
    """
    eligible = [
        F.when(F.col(p_col)[j] >= F.lit(threshold), F.col(p_col)[j])
        for j, threshold in sorted(thresholds.items())
    ]
    classes = F.array(*[F.lit(j) for j in sorted(thresholds)])
    return (
        df.withColumn("_eligible", F.array(*eligible))
        .withColumn(out, F.try_element_at(classes, argmax_label(F.col("_eligible")) + 1))
        .drop("_eligible")
    )


def joint_cells(
    df: DataFrame, n_classes: int, index_col: str = "label_index", p_col: str = "p"
) -> list[tuple[int, int, int, int]]:
    """(given, confident, n, calibrated) for all K*K cells.

    n: rows with this given label and confident class; see ``calibrate`` for the
    calibrated count. Spark averages and counts the rows; K thresholds and
    K*(K+1) counts come to the driver.
    """
    known = df.filter(F.col(index_col).isNotNull())
    thresholds = {
        row[index_col]: row.threshold for row in class_thresholds(df, index_col, p_col).collect()
    }
    if not thresholds:
        return []
    found = (
        with_confident_class(known, thresholds, p_col)
        .groupBy(F.col(index_col).alias("given"), "confident")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    counts = [[0] * n_classes for _ in range(n_classes)]
    sizes = [0] * n_classes
    for row in found:
        sizes[row.given] += row.n
        if row.confident is not None:
            counts[row.given][row.confident] += row.n
    calibrated = [calibrate(counts[i], i, sizes[i]) for i in range(n_classes)]
    classes = range(n_classes)
    return [(i, j, counts[i][j], calibrated[i][j]) for i in classes for j in classes]


def confident_joint(
    df: DataFrame, n_classes: int, index_col: str = "label_index", p_col: str = "p"
) -> DataFrame:
    """``joint_cells`` as a table."""
    return df.sparkSession.createDataFrame(
        joint_cells(df, n_classes, index_col, p_col),
        "given int, confident int, n bigint, calibrated bigint",
    )


def calibrate(counts: Sequence[int], own: int, size: int) -> list[int]:
    """Scale one class's counts so that they sum to its size, in whole numbers.

    The own cell counts as at least one. Fractions are rounded by largest
    remainder, lower classes first on ties; an own cell that would round to
    zero is served first, so a class never loses all of its rows.
    """
    raised = [max(n, 1) if j == own else n for j, n in enumerate(counts)]
    total = sum(raised)
    shares = [divmod(n * size, total) for n in raised]
    result = [whole for whole, _ in shares]
    turn = sorted(
        range(len(counts)),
        key=lambda j: (not (j == own and result[j] == 0 and shares[j][1]), -shares[j][1], j),
    )
    for j in turn[: size - sum(result)]:
        result[j] += 1
    return result


def prune_quotas(
    cells: Sequence[tuple[int, int, int, int]], n_classes: int, frac_noise: float = FRAC_NOISE
) -> dict[int, int]:
    """Pair (given * K + other) -> rows to prune, where there are any."""
    quotas = {
        given * n_classes + other: math.floor(frac_noise * calibrated)
        for given, other, _, calibrated in cells
        if given != other
    }
    return {pair: quota for pair, quota in quotas.items() if quota > 0}


def find_label_issues(
    df: DataFrame,
    n_classes: int,
    id_col: str,
    index_col: str = "label_index",
    p_col: str = "p",
    frac_noise: float = FRAC_NOISE,
    out: str = "is_label_issue",
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add the issue flag to ``df``.

    For each pair (given i, other j) the quota of rows of class i with the
    largest margin p_j - p_i is flagged, ties in id order, unless i is the most
    probable class. As in sampling, the last row inside each quota is found
    from narrow keys and every row is compared with that cut: the documents are
    neither joined nor shuffled. ``df`` is read four times, so pass a table.
    """
    cells = joint_cells(df, n_classes, index_col, p_col)
    quotas = prune_quotas(cells, n_classes, frac_noise)
    if not quotas:
        return df.withColumn(out, F.lit(False))
    cuts = margin_cuts(df, quotas, n_classes, id_col, index_col, p_col, window_rows)
    given, p, row_id = F.col(index_col), F.col(p_col), F.col(id_col)
    id_type = df.schema[id_col].dataType
    inside = F.lit(False)
    for pair, (gap, last_id) in cuts.items():
        i, j = divmod(pair, n_classes)
        key = F.struct((p[i] - p[j]).alias("gap"), row_id.alias("id"))
        cut = F.struct(F.lit(gap).alias("gap"), F.lit(last_id).cast(id_type).alias("id"))
        inside = inside | ((given == i) & (key <= cut))
    return df.withColumn(out, F.coalesce(inside & (argmax_label(p) != given), F.lit(False)))


def margin_cuts(
    df: DataFrame,
    quotas: Mapping[int, int],
    n_classes: int,
    id_col: str,
    index_col: str = "label_index",
    p_col: str = "p",
    window_rows: int = WINDOW_ROWS,
) -> dict:
    """Pair -> (gap, id) of the last row to flag; gap = p_i - p_j.

    A histogram of the gaps finds the bucket in which each quota is reached;
    only those buckets are ranked. Equal gaps may put a large part of the table
    into one of them: above ``window_rows`` rows, which the histogram tells, the
    ranks come from a distributed sort instead of a window.
    """
    exploded = df.select(
        F.col(id_col).alias("_id"),
        F.col(index_col).alias("_i"),
        label_quality(F.col(p_col), F.col(index_col)).alias("_own"),
        F.posexplode(p_col).alias("_j", "_other"),
    ).select(
        (F.col("_i") * n_classes + F.col("_j")).alias("_pair"),
        (F.col("_own") - F.col("_other")).alias("_gap"),
        "_id",
    )
    pair = F.col("_pair")
    candidates = exploded.filter(pair.isin(list(quotas)))
    bucket = F.floor((F.col("_gap") + 1.0) * (_MARGIN_BUCKETS / 2))
    sizes = candidates.groupBy("_pair", bucket.alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    edges = edge_buckets(sizes, "_pair", F.try_element_at(literal_map(quotas), pair)).collect()
    if not edges:
        return {}
    bucket_of = literal_map({row._pair: row._bucket for row in edges})
    last_of = literal_map({row._pair: min(row._room, row._n) for row in edges})
    on_edge = candidates.filter(bucket == F.try_element_at(bucket_of, pair))
    if max(row._n for row in edges) <= window_rows:
        window = Window.partitionBy("_pair").orderBy("_gap", "_id")
        ranked = on_edge.withColumn("_rank", F.row_number().over(window))
    else:
        ranked = rank_within(on_edge, "_pair", ["_gap", "_id"], "_rank")
    last = ranked.filter(F.col("_rank") == F.try_element_at(last_of, pair)).collect()
    return {row._pair: (row._gap, row._id) for row in last}


def rank_issues(flagged: DataFrame, id_col: str, score_col: str = "label_quality_score") -> DataFrame:
    """Flagged rows with their rank by ascending quality, worst first (1)."""
    return ordered_position(flagged, [score_col, id_col], "_at").withColumn(
        "issue_rank", F.col("_at") + 1
    ).drop("_at")


def worst_k(
    flagged: DataFrame,
    id_col: str,
    k: int = 5,
    text_col: str = "text",
    prefix_chars: int | None = None,
    score_col: str = "label_quality_score",
) -> DataFrame:
    """The ``k`` flagged rows of lowest quality, text cut for display if asked for."""
    worst = flagged.orderBy(score_col, id_col).limit(k)
    if prefix_chars is None:
        return worst
    return worst.withColumn(text_col, F.substring(text_col, 1, prefix_chars))


def issues_per_class(df: DataFrame, label_col: str, flag_col: str = "is_label_issue") -> DataFrame:
    """Rows and flagged rows of each class, zeros included."""
    return df.groupBy(label_col).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag_col)).alias("flagged")
    )


def noise_summary(df: DataFrame, flag_col: str = "is_label_issue") -> DataFrame:
    flagged = F.count_if(F.col(flag_col))
    return df.agg(
        F.count(F.lit(1)).alias("n_input"),
        flagged.alias("n_flagged"),
        (F.count(F.lit(1)) - flagged).alias("n_clean"),
        F.try_divide(flagged * F.lit(100.0), F.count(F.lit(1))).alias("pct_flagged"),
    )


def noise_report(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    label_col: str = "rating",
    flag_col: str = "is_label_issue",
    k: int = 5,
    prefix_chars: int | None = None,
) -> DataFrame:
    """The noise figures as (section, key, detail, value).

    Sections: summary, class (flagged rows of every class) and worst (the ``k``
    rows of lowest quality, by id, with given and suggested label and text).
    """
    summary = noise_summary(df, flag_col)
    entries = [
        _report_entry("summary", F.lit(name), F.lit(""), F.col(name)) for name in summary.columns
    ]
    classes = issues_per_class(df, label_col, flag_col)
    worst = worst_k(df.filter(F.col(flag_col)), id_col, k, text_col, prefix_chars)
    labels = F.format_string(
        "%d -> %d: %s", F.col(label_col).cast("int"), F.col("suggested_rating").cast("int"), text_col
    )
    parts = [
        summary.select(F.inline(F.array(*entries))),
        classes.select(
            F.inline(F.array(_report_entry("class", F.col(label_col), F.lit(""), F.col("flagged"))))
        ),
        worst.select(
            F.inline(
                F.array(_report_entry("worst", F.col(id_col), labels, F.col("label_quality_score")))
            )
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def _report_entry(section: str, key: Column, detail: Column, value: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        key.cast("string").alias("key"),
        detail.alias("detail"),
        value.cast("double").alias("value"),
    )
