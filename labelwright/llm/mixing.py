"""Mixing sources to target weights, in DataFrame operations only.

Each row gets a hash-random key. Rows are sorted by key within their source, and the
distributed prefix sum of sizes over that order says which words of the source lie
before its budget. The prefix sum has two levels: ranges of the key (a histogram of
``buckets`` ranges per source), and a window inside each range. So a source that holds
a third of all rows is spread over many tasks, and equally everywhere else.

Targets: all sizes together are shared by weight; no source may take more than
``max_epochs`` times its size, and what it can't take is shared again by weight among
the rest, until none is above. A budget of more than the source's size takes whole
epochs first; the rest is cut out of one more, at the exact word.

Defined results: a null text has size 0; rows of size 0 take 0; a null source is a
source of its own, last in order; repeated rows count each; rows that agree in key,
id, size and text are interchangeable; an empty table gives no rows. Extra columns
stay, whatever their names. The same rows give the same mix on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelwright.llm.common import BLANK, WORD, free_name, text_or_empty
from labelwright.operators.position import ordered_position
from labelwright.session import spool

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 2048
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``sizes`` (source, source_size) with ``weight`` and ``target`` added.

    Weights repeat along the sources in code point order, null last. The share by
    weight is a level: a source takes ``level * weight``, or its cap if that is less.
    Each turn fixes the sources above their cap and shares the rest anew; the level
    only rises, so the turns end. A turn is one aggregate over the sources.
    """
    order = [F.col("source").isNull(), F.col("source")]
    weight = F.element_at(
        F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")
    )
    placed = spool(
        ordered_position(sizes, order, "_place").select(
            "source", "source_size", weight.cast("double").alias("weight"),
            (F.col("source_size") * F.lit(float(max_epochs))).alias("_cap"),
        ),
        "sources",
    )
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("_cap") <= F.col("weight") * F.lit(level)
        free = F.when(~above, F.col("weight"))
        row = placed.agg(
            F.count(F.when(above, 1)).alias("n"),
            F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(free), F.lit(0.0)).alias("w"),
        ).first()
        if row.n == capped or row.w == 0:
            break
        capped, level = row.n, (total - row.held) / row.w
    return placed.select(
        "source", "source_size", "weight",
        F.least("_cap", F.col("weight") * F.lit(level)).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with size, source_size, target and taken added.

    ``taken`` counts the words that the mix takes from the row, repeats included.
    Columns of the input that have one of these names are replaced.
    """
    added = ("size", "source_size", "target", "taken")
    kept = [name for name in docs.columns if name.lower() not in added]
    names = {x: free_name(docs.columns, f"_mix_{x}") for x in
             ("known", "source", "key", "print", "bucket", "size", "start", "total", "target")}
    n = {k: F.col(v) for k, v in names.items()}
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    keyed = (
        docs.select(
            *kept,
            F.col(source_col).isNotNull().alias(names["known"]),
            F.coalesce(F.col(source_col), F.lit("")).alias(names["source"]),
            key.alias(names["key"]),
            F.xxhash64(F.col(text_col)).alias(names["print"]),
            word_count(text_or_empty(text_col)).alias(names["size"]),
        )
        # Equal ranges of the key: its leading bits.
        .withColumn(
            names["bucket"],
            F.shiftrightunsigned(n["key"], 40) % F.lit(buckets) if buckets & (buckets - 1)
            else F.shiftrightunsigned(n["key"], 64 - (buckets.bit_length() - 1)),
        )
    )
    at = [names["source"], names["known"], names["bucket"]]
    histogram = spool(keyed.groupBy(*at).agg(F.sum(n["size"]).alias("_words")), "mix")
    sizes = spool(
        histogram.groupBy(*at[:2]).agg(F.sum("_words").alias("source_size")).select(
            F.when(n["known"], n["source"]).alias("source"), "source_size"
        ),
        "sizes",
    )
    targets = source_targets(sizes, weights, max_epochs).select(
        F.coalesce("source", F.lit("")).alias(names["source"]),
        F.col("source").isNotNull().alias(names["known"]),
        F.col("source_size").alias(names["total"]),
        F.col("target").alias(names["target"]),
    )
    earlier = Window.partitionBy(*at[:2]).orderBy(names["bucket"]).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranges = histogram.select(
        *at, F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias(names["start"])
    ).join(targets, at[:2])
    inside = (
        Window.partitionBy(*at)
        .orderBy(names["key"], id_col, names["size"], names["print"])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = n["start"] + F.coalesce(F.sum(n["size"]).over(inside), F.lit(0))
    whole = F.when(n["total"] > 0, F.floor(F.floor(n["target"]) / n["total"])).otherwise(0)
    rest = F.floor(n["target"]) - whole * n["total"]
    part = F.greatest(F.lit(0), F.least(n["size"], rest - before))
    return keyed.join(ranges, at).select(
        *kept,
        n["size"].alias("size"),
        n["total"].alias("source_size"),
        n["target"].alias("target"),
        (whole * n["size"] + part).cast("long").alias("taken"),
    )


def first_words(text: Column, count: Column) -> Column:
    """The text through its ``count``-th word, blanks between words as they are."""
    pieces = F.regexp_extract_all(text, F.lit(f"[{BLANK}]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, 1, count), "")


def mixed_rows(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: a row of ``mixed`` once per epoch it is taken in.

    The one row of a source at which its budget ends adds its first words only, up
    to the budget. Rows that the mix leaves out are gone; so are the four added columns.
    """
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    parts = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")),
        F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")),
    )
    part = free_name(mixed.columns, "_part")
    kept = [name for name in mixed.columns if name not in ("size", "source_size", "target", "taken")]
    rows = mixed.select(*kept, F.explode(parts).alias(part))
    cut = F.when(F.col(part) < 0, F.col(text_col)).otherwise(
        first_words(F.col(text_col), F.col(part).cast("int"))
    )
    return rows.select(*[cut.alias(text_col) if name == text_col else name for name in kept])
