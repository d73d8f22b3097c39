"""Confident learning against a plain-Python reading of the rule."""

import math
import random

import pytest

from labelwright.operators import confident
from labelwright.plans.noise import score_labels

K = 3


def brute_force(rows, frac):
    """rows: (id, label, p). Returns (joint, flagged ids)."""
    thresholds = {}
    for i in range(K):
        own = [p[i] for _, label, p in rows if label == i]
        if own:
            thresholds[i] = sum(own) / len(own)
    counts = [[0] * K for _ in range(K)]
    for _, label, p in rows:
        sure = [j for j in thresholds if p[j] >= thresholds[j]]
        if sure:
            counts[label][max(sure, key=lambda j: (p[j], -j))] += 1
    joint = []
    for i in range(K):
        size = sum(label == i for _, label, _ in rows)
        joint.append(confident.calibrate(counts[i], i, size))
    flagged = set()
    for i in range(K):
        for j in range(K):
            if i == j:
                continue
            members = sorted((p[i] - p[j], row_id) for row_id, label, p in rows if label == i)
            flagged |= {row_id for _, row_id in members[: math.floor(frac * joint[i][j])]}
    best = {row_id: max(range(K), key=lambda j: (p[j], -j)) for row_id, _, p in rows}
    given = {row_id: label for row_id, label, _ in rows}
    return joint, {row_id for row_id in flagged if best[row_id] != given[row_id]}


def random_rows(seed, n=400, copies=0.33):
    """A third of the rows share one probability vector, so margins tie."""
    source = random.Random(seed)
    rows = []
    for row_id in range(n):
        label = source.choice([0, 0, 0, 1, 2])
        if source.random() < copies:
            p = [0.25, 0.5, 0.25]
        else:
            w = [source.random() + (0.6 if j == label else 0) for j in range(K)]
            p = [x / sum(w) for x in w]
        rows.append((row_id, label, p))
    return rows


@pytest.mark.parametrize(("seed", "frac", "window_rows"), [(1, 1.0, 10**6), (2, 0.5, 10**6), (3, 0.7, 0), (4, 0.05, 0)])
def test_find_label_issues(spark, seed, frac, window_rows):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, "id bigint, label_index int, p array<double>").repartition(5)
    joint, flagged = brute_force(rows, frac)
    cells = confident.joint_cells(df, K)
    assert [[c[3] for c in cells if c[0] == i] for i in range(K)] == joint
    got = confident.find_label_issues(df, K, "id", frac_noise=frac, window_rows=window_rows)
    assert {r.id for r in got.filter("is_label_issue").collect()} == flagged
    assert got.count() == len(rows)


@pytest.mark.parametrize(
    ("counts", "own", "size", "expected"),
    [
        ([0, 0, 0], 1, 10, [0, 10, 0]),
        ([5, 5, 0], 0, 10, [5, 5, 0]),
        ([1, 1, 1], 0, 10, [4, 3, 3]),
        ([1, 99, 0], 0, 10, [1, 9, 0]),
        ([0, 50, 50], 0, 5, [1, 2, 2]),
        ([0, 0, 0], 0, 0, [0, 0, 0]),
    ],
)
def test_calibrate(counts, own, size, expected):
    assert confident.calibrate(counts, own, size) == expected
    assert sum(confident.calibrate(counts, own, size)) == size


def test_a_class_may_be_absent(spark):
    rows = [(i, i % 2, [0.6, 0.3, 0.1] if i % 4 else [0.2, 0.7, 0.1]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, label_index int, p array<double>")
    _, flagged = brute_force(rows, 1.0)
    got = confident.find_label_issues(df, K, "id", frac_noise=1.0)
    assert {r.id for r in got.filter("is_label_issue").collect()} == flagged


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id bigint, label_index int, p array<double>")
    assert confident.find_label_issues(empty, K, "id").count() == 0


def test_first_largest_probability_wins(spark):
    df = spark.createDataFrame([(1, 0, [0.4, 0.4, 0.2])], "id bigint, label_index int, p array<double>")
    assert df.select(confident.argmax_label(df.p)).first()[0] == 0


def test_score_labels_keeps_every_row(spark):
    rows = random_rows(9)
    df = spark.createDataFrame(rows, "id bigint, label_index int, p array<double>")
    scored = score_labels(df, "id", (1.0, 2.0, 3.0), 1.0)
    assert scored.count() == len(rows)
    assert set(scored.columns) == {"id", "label_quality_score", "is_label_issue", "suggested_rating"}
    own = {row_id: p[label] for row_id, label, p in rows}
    assert {r.id: r.label_quality_score for r in scored.collect()} == own
