import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwright.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, node string"


def brute(rows, k=20, step=20):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(np.float32(v).tolist())))
    wide = max((len(v) for _, v in good), default=1)
    ids = np.array([i for i, _ in good])
    x = np.array([list(v) + [0.0] * (wide - len(v)) for _, v in good])
    out = {}
    for i in sorted({int(i) for i in ids if i % step == 0}):
        own = x[ids == i][0]
        scores = x @ own
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(spark, rows, k=20):
    df = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 20 == 0, k).collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_small_tables_are_exact_with_odd_rows_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist(), "x") for i in range(120)]
    hot = rng.normal(size=6).astype(np.float32).tolist()
    rows += [(1000 + i, hot, "x") for i in range(60)]
    rows += [(2000, None, ""), (2020, [], ""), (2040, [0.0] * 6, ""), (2060, [1.0, None], ""),
             (2080, [float("nan")] * 6, ""), (2100, [float("inf")] * 6, ""), (2120, [1.5, 2.5], "short"),
             (None, [1.0] * 6, ""), rows[40], rows[40]]
    random.Random(0).shuffle(rows)
    got, want = found(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])


def test_fewer_candidates_than_asked_for(spark):
    rows = [(20, [1.0, 0.0], ""), (3, [0.5, 0.5], ""), (4, [-1.0, 0.0], "")]
    assert [i for i, _ in found(spark, rows)[20]] == [3, 4]
    assert found(spark, rows[:1]) == {}
    assert found(spark, []) == {}


def test_recall_on_vectors_without_structure(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8000, 32)) * rng.uniform(0.8, 1.2, size=(8000, 1))
    rows = [(i, v, "") for i, v in enumerate(x.astype(np.float32).tolist())]
    got, want = found(spark, rows), brute(rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
