import re

import pytest
from pyspark.sql import functions as F

from labelwright.llm.mixing import first_words, mix, mixed_rows

SCHEMA = "doc_id long, text string, source string, _mix_key int, SIZE2 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), epochs=3):
    """Targets by repeated sharing over plain dictionaries."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > epochs * sizes[s]]
        if not above:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: float(epochs * sizes[s]) for s in above}


def rows():
    out = [(i, "w " * (i % 13), "hot", 0, "x") for i in range(300)]
    out += [(1000 + i, "äé x\ny z " * (i % 5), f"s{i % 7}", 1, None) for i in range(140)]
    out += [(2000, None, "s1", 2, ""), (2001, "", None, 3, ""), (2002, "a b c", None, 4, ""),
            (2003, "lone " * 40, "tiny", 5, ""), (None, "no id here", "s2", 6, ""),
            (2004, "twice the same", "s3", 7, ""), (2004, "twice the same", "s3", 7, "")]
    return out


def test_targets_and_cuts(spark):
    data = rows()
    got = mix(spark.createDataFrame(data, SCHEMA), buckets=16).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, text, source, *_ in data:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r.size == len(WORD.findall(r.text or ""))
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, t in want.items():
        assert taken[source] == int(t + 1e-9) or abs(taken[source] - t) <= 1
    assert all(r["_mix_key"] is not None and "SIZE2" in r.asDict() for r in got)


def test_reruns_agree_on_another_layout(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    first = sorted(map(str, mix(df, buckets=16).select("doc_id", "taken").collect()))
    again = sorted(map(str, mix(df.repartition(5), buckets=16).select("doc_id", "taken").collect()))
    assert first == again


def test_mixed_rows_hold_the_words_taken(spark):
    plan = mix(spark.createDataFrame(rows(), SCHEMA), buckets=16)
    out = mixed_rows(plan)
    assert out.columns == ["doc_id", "text", "source", "_mix_key", "SIZE2"]
    words = sum(len(WORD.findall(r.text)) for r in out.collect())
    assert words == plan.agg(F.sum("taken")).first()[0]


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_first_words(spark):
    df = spark.createDataFrame([(" a\tb  c ", 2), ("x", 1)], "t string, n int")
    assert [r[0] for r in df.select(first_words(F.col("t"), F.col("n"))).collect()] == [" a\tb", "x"]
