"""Quality rules: rule statistics of each text, and an isolation forest over them.

The statistics need one pass over the texts and no shuffle; they are written once, and
everything after reads those narrow rows. The forest is fitted on the statistics of at
most ``POOL`` rows, the first in hash order, which is all that comes to the driver. Each
tree splits a part of them at random; rows that few splits set apart have short paths
and a score near 1. The threshold comes from labelled rows: a histogram of scores by
label, and the cut that separates best when a good document lost counts ``COST`` times
a bad one found.

Defined results: a null or empty text has no words and fails the base rules; repeated
rows repeat; null or missing labels do not count; without usable labels of both kinds
no document is cut by the forest; an empty table gives no rows; extra columns stay,
those named like a statistic are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from labelwright.llm.common import small_slices
from labelwright.session import spool

RUN = 8
TREES = 128
PER_TREE = 256
POOL = 8192
BINS = 1000
USUAL_DUP = 0.35
USUAL_REPEAT = 0.25
COST = 4.0
SEED = 7

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbol_share", "mark_share", "upper_share", "dup_share",
          "repeat_share", "distinct_share", "stop_share")

#: Bytes by kind.
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = False
_MARK[list(b".,'-")] = False
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


def _repeated(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which words lie in a window of RUN words that the same text holds twice."""
    n = len(codes) - RUN + 1
    out = np.zeros(len(codes), bool)
    if n < 2:
        return out
    # A hash rules out windows that are alone; those left are compared word by word.
    with np.errstate(over="ignore"):
        word = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        word ^= word >> np.uint64(29)
        word *= np.uint64(0xBF58476D1CE4E5B9)
        hashed = owner[:n].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        for i in range(RUN):
            hashed = hashed * np.uint64(0xD6E8FEB86659FD93) + word[i : i + n]
    inside = owner[:n] == owner[RUN - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.argsort(hashed[at], kind="stable")]
    same = hashed[order[1:]] == hashed[order[:-1]]
    twin = np.zeros(len(order), bool)
    twin[1:] |= same
    twin[:-1] |= same
    at = order[twin]
    if not len(at):
        return out
    rows = np.column_stack([owner[at], *[codes[at + i] for i in range(RUN)]])
    _, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[count[inverse.ravel()] > 1]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + RUN, -1)
    return np.cumsum(cover[:-1]) > 0


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and SHARES of each text."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    size = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + size + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[bounds[1:]] - total[bounds[:-1]]

    blank = _BLANK[raw]
    word_chars = per_text(~blank & ~_CONTINUES[raw])
    starts = ~blank
    if len(raw):
        starts[1:] &= blank[:-1]
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        starts[first] = ~blank[first]
    n_words = per_text(starts)

    lists = pc.ascii_split_whitespace(texts)
    flat = pc.list_flatten(lists)
    owner = np.repeat(np.arange(size), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    owner = owner[real.to_numpy(zero_copy_only=False)]
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    repeat = np.bincount(owner, _repeated(codes, owner), minlength=size).astype(np.int64)
    distinct = np.bincount(
        np.unique(owner * (len(coded.dictionary) + 1) + codes) // (len(coded.dictionary) + 1),
        minlength=size,
    )

    split = pc.split_pattern(texts, "\n")
    lines = pc.list_flatten(split)
    of = np.repeat(np.arange(size), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    line = lines.filter(full).dictionary_encode()
    of = of[full.to_numpy(zero_copy_only=False)]
    key = of * (len(line.dictionary) + 1) + line.indices.to_numpy(zero_copy_only=False)
    n_lines = np.bincount(of, minlength=size)
    n_dup = n_lines - np.bincount(np.unique(key) // (len(line.dictionary) + 1), minlength=size)

    chars = np.maximum(word_chars, 1)
    words = np.maximum(n_words, 1)
    symbols = per_text(_SYMBOL[raw])
    letters = np.maximum(word_chars - per_text(_MARK[raw] | _DIGIT[raw]), 1)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": n_dup,
        "n_repeat_words": repeat,
        "symbol_share": symbols / chars,
        "mark_share": per_text(_MARK[raw]) / chars,
        "upper_share": per_text(_UPPER[raw]) / letters,
        # Some repetition is ordinary; what counts is the excess.
        "dup_share": np.maximum(n_dup / np.maximum(n_lines, 1) - USUAL_DUP, 0.0),
        "repeat_share": np.maximum(repeat / words - USUAL_REPEAT, 0.0),
        # Long texts use words again: the share is held against what their length lets expect.
        "distinct_share": distinct / words**0.85,
        "stop_share": np.minimum(per_text(_STOP[raw]) / words, 1.0),
    }


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of COUNTS and SHARES; the text goes."""
    named = {*(n.lower() for n in (*COUNTS, *SHARES)), text_col.lower()}
    kept = [f for f in docs.schema.fields if f.name.lower() not in named]
    schema = StructType(
        [*kept, *[StructField(n, LongType()) for n in COUNTS], *[StructField(n, DoubleType()) for n in SHARES]]
    )
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches, text_col):
            found = text_statistics(part.column(text_col))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in names],
                 *[pa.array(found[n].astype(np.int64)) for n in COUNTS],
                 *[pa.array(found[n].astype(float)) for n in SHARES]],
                [*names, *COUNTS, *SHARES],
            )

    return docs.select(*names, text_col).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _usual_path(n: np.ndarray | float) -> np.ndarray | float:
    """Mean path of an unsuccessful search among n rows (Liu, Ting and Zhou 2008)."""
    n = np.asarray(n, float)
    safe = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(safe) + 0.5772156649) - 2 * safe / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: feature, value, left, right, and the path length at each leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    depth: int
    per_tree: int

    @classmethod
    def fit(cls, rows: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        per_tree = min(per_tree, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(per_tree, 2)))))
        grown = []
        for _ in range(trees):
            tree: list[list[float]] = []

            def grow(part: np.ndarray, level: int, tree: list = tree) -> int:
                at = len(tree)
                tree.append([-1, 0.0, at, at, level + float(_usual_path(len(part)))])
                low, high = part.min(axis=0), part.max(axis=0)
                able = np.flatnonzero(high > low)
                if level < depth and len(part) > 1 and len(able):
                    f = int(rng.choice(able))
                    cut = rng.uniform(low[f], high[f])
                    below = part[:, f] <= cut
                    if below.all():
                        below = part[:, f] < part[:, f].max()
                        cut = part[below, f].max()
                    tree[at][:2] = [f, cut]
                    tree[at][2] = grow(part[below], level + 1)
                    tree[at][3] = grow(part[~below], level + 1)
                return at

            grow(rows[rng.choice(len(rows), per_tree, replace=False)], 0)
            grown.append(np.array(tree))
        wide = max(map(len, grown))
        cube = np.stack([np.pad(t, ((0, wide - len(t)), (0, 0))) for t in grown])
        return cls(
            cube[:, :, 0].astype(np.int64), cube[:, :, 1], cube[:, :, 2].astype(np.int64),
            cube[:, :, 3].astype(np.int64), cube[:, :, 4], depth, per_tree,
        )

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): near 1 for rows soon set apart."""
        total = np.zeros(len(rows))
        index = np.arange(len(rows))
        for feature, value, left, right, path in zip(
            self.feature, self.value, self.left, self.right, self.path
        ):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                below = rows[index, np.maximum(f, 0)] <= value[at]
                at = np.where(f < 0, at, np.where(below, left[at], right[at]))
            total += path[at]
        usual = max(float(_usual_path(self.per_tree)), 1e-9)
        return 2.0 ** (-total / len(self.feature) / usual)


def fit_forest(statistics: DataFrame, id_col: str = "doc_id", pool: int = POOL) -> Forest | None:
    """A forest over the first ``pool`` rows in hash order that pass the base rules."""
    rows = (
        statistics.where(~base_failed())
        .orderBy(F.xxhash64(F.lit("forest"), id_col), *SHARES)
        .limit(pool).select(*SHARES).toPandas()
    )
    return Forest.fit(rows.to_numpy(float)) if len(rows) else None


def with_score(statistics: DataFrame, forest: Forest, out: str = "anomaly") -> DataFrame:
    shared = statistics.sparkSession.sparkContext.broadcast(forest)
    kept = [f for f in statistics.schema.fields if f.name.lower() != out.lower()]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack(
                [batch.column(n).to_numpy(zero_copy_only=False) for n in SHARES]
            ).astype(float)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(shared.value.score(rows))], [*names, out]
            )

    return statistics.mapInArrow(run, StructType([*kept, StructField(out, DoubleType())]))


def threshold(
    scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
    cost: float = COST,
) -> float:
    """The score from which on documents are cut; above 1 if labels give no cut."""
    known = labels.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("_id"), (F.col(label_col) == 0).alias("_bad")
    )
    counted = (
        scored.where(~base_failed()).select(F.col(id_col).alias("_id"), F.floor(F.col("anomaly") * BINS).cast("int").alias("_bin"))
        .join(known, "_id").groupBy("_bin", "_bad").count().collect()
    )
    bad, good = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for row in counted:
        (bad if row._bad else good)[row._bin] += row["count"]
    if not bad.sum() or not good.sum():
        return 2.0
    found = np.cumsum(bad[::-1])[::-1] / bad.sum()
    lost = np.cumsum(good[::-1])[::-1] / good.sum()
    gain = found - cost * lost
    best = int(np.argmax(gain))
    return best / BINS if gain[best] > 0 else 2.0


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without texts, with statistics, ``base_failed``, ``anomaly`` and ``kept``."""
    statistics = spool(with_statistics(docs, text_col), "statistics")
    forest = fit_forest(statistics, id_col)
    if forest is None:
        return statistics.select(
            "*", F.lit(None).cast("double").alias("anomaly"), base_failed().alias("base_failed"),
            (~base_failed()).alias("kept"),
        )
    scored = with_score(statistics, forest)
    cut = threshold(scored, labels, id_col)
    return scored.select(
        "*", base_failed().alias("base_failed"),
        (~base_failed() & (F.col("anomaly") < cut)).alias("kept"),
    )
