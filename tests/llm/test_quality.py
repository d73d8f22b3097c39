import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from labelwright.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(runs)
    covered = {j for i, r in enumerate(runs) if count[r] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def texts():
    rng = random.Random(4)
    out = [None, "", " \t\x0b", "a b\r\na b\r\n a b", "x " * 17, "\n\na\n\na\na", "é🙂 \x1c \xa0 ü", "|#| <b> &amp;"]
    for _ in range(150):
        words = rng.choices(["a", "b", "é", "cc", "🙂", "#x"], k=rng.randrange(60))
        out.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words))
    return out


def test_counts_equal_brute_force():
    data = texts()
    got = quality.text_statistics(pa.array(data, pa.string()))
    for i, text in enumerate(data):
        assert tuple(int(got[n][i]) for n in quality.COUNTS) == brute(text), repr(text)
    part = quality.text_statistics(pa.array(data, pa.string()).slice(5, 40))
    for n in quality.COUNTS:
        assert part[n].tolist() == got[n][5:45].tolist()


def test_paths_equal_a_walk():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(0, 1, (400, 3)), [[9, 9, 9]], np.zeros((5, 3))])
    forest = quality.Forest.fit(rows, trees=20, per_tree=64)

    def walk(t, row):
        at = 0
        while forest.feature[t][at] >= 0:
            side = forest.left if row[forest.feature[t][at]] <= forest.value[t][at] else forest.right
            at = side[t][at]
        return forest.path[t][at]

    got = forest.score(rows)
    for i in (0, 7, 400, 402):
        mean = np.mean([walk(t, rows[i]) for t in range(20)])
        assert got[i] == pytest.approx(2 ** (-mean / float(quality._usual_path(64))))
    assert got.argmax() == 400
    assert quality.Forest.fit(np.zeros((1, 3))).score(np.zeros((2, 3))).tolist() == [1.0, 1.0]


def corpus():
    rng = random.Random(2)
    parts = ["the", "er", "an", "on", "ing", "ed", "st", "nd"]
    rows = []
    for i in range(300):
        words = ["".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(60)]
        if i % 10 == 0:
            words = [w + rng.choice(["###", "$$$", "&&&"]) for w in words]
        rows.append((i, " ".join(words), "clash", i % 10 and 1))
    return rows


def test_junk_goes_and_clean_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame(
        [r[:3] for r in rows] + [(900, None, ""), (901, "too short", ""), (None, "w " * 40, ""), (1, rows[1][1], "")],
        "doc_id long, text string, N_WORDS string",
    )
    labels = spark.createDataFrame(
        [(r[0], r[3]) for r in rows[:200]] + [(250, None), (None, 0)], "doc_id long, quality int"
    )
    got = quality.judge(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id in (900, 901, None):
            assert r.base_failed and not r.kept
        else:
            assert not r.base_failed
            if r.doc_id % 10 == 0:
                assert not r.kept
    clean = [r.kept for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 10]
    assert sum(clean) >= 0.97 * len(clean)
    again = quality.judge(docs.repartition(3), labels).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([r[:2] for r in corpus()], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in quality.judge(docs, none).collect())
    assert quality.judge(docs.limit(0), none).collect() == []
