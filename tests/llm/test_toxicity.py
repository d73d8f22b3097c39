import math
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelwright.llm import toxicity as tox
from labelwright.llm.toxicity import _matrix


def brute_kernel(a, b):
    def features(s):
        out = defaultdict(float)
        for i, j, k in combinations(range(len(s)), 3):
            if k - i < tox.SPAN:
                out[s[i] + s[j] + s[k]] += tox.DECAY ** (k - i + 1)
        return out

    x, y = features(a), features(b)
    dot = sum(v * y.get(k, 0) for k, v in x.items())
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return dot / norm if norm else 0.0


STRINGS = ["^idiot$", "^idxiot$", "^i-d-i-o-t$", "^clown$", "^réeuxê$", "^ab$", "^" + "aba" * 6 + "$", "^🙂🙂🙂$"]


def test_kernel_equals_enumeration():
    for a in STRINGS:
        for b in STRINGS:
            assert tox.kernel(a, b) == pytest.approx(brute_kernel(a, b))
    own = tox.self_kernels(_matrix(STRINGS))
    assert own == pytest.approx([sum(v * v for v in tox.feature_map(s).values()) for s in STRINGS])
    marks = STRINGS[:5]
    got = tox.Scorer.of(marks, np.eye(len(marks)))(STRINGS, block=3)
    assert got == pytest.approx(np.array([[brute_kernel(s, m) for m in marks] for s in STRINGS]))
    assert brute_kernel("^idiot$", "^idxiot$") > 0.5 > brute_kernel("^idiot$", "^clown$")


def corpus(n, seed):
    rng = random.Random(seed)
    parts = ["the", "er", "an", "on", "ing", "ed", "st", "nd", "re", "ly", "ou", "ha"]
    insults = ["idiot", "moron", "scum", "worthless"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words) + ".", int(bad)))
    return rows


def model_of(rows):
    return tox.fit([r[1] for r in rows], np.array([r[2] for r in rows]), 0.25)


def test_held_out_accuracy_and_inserted_characters():
    model = model_of(corpus(400, 1))
    test = corpus(200, 2)
    p = model.probabilities(tox.document_features(pa.array([r[1] for r in test]), tox.Memory(model)))
    truth = np.array([r[2] for r in test])
    assert ((p >= 0.3) == truth).mean() > 0.95
    clean = "the ering andou lyst. the onre haed. "
    hidden = [clean + w + " the nd." for w in ("i-d-i-o-t", "idxiot", "mo.ron", "i d i o t", "WORTHLESS!", "scuum")]
    worst = tox.document_features(pa.array([clean, *hidden]), tox.Memory(model))[:, 0]
    assert (worst[1:] > worst[0]).all()


def test_long_words_and_texts_are_read_whole():
    model = model_of(corpus(400, 1))
    text = "the on " * 30000 + "idiot"
    f = tox.document_features(pa.array([text, "the on " * 30000, "x" * 5000 + "idiot"]), tox.Memory(model))
    assert f[0, 0] > 0 > f[1, 0]
    assert "".join(tox.forms("x" * 500 + "idiot")).count("idiot") >= 1


def test_edges(spark):
    rows = corpus(120, 3)
    docs = spark.createDataFrame(
        [(i, t, "own") for i, t, _ in rows] + [(5000, None, "own"), (5001, "", ""), (None, "the", ""), (4, rows[4][1], "twin")],
        "doc_id long, text string, SCORE string",
    )
    labels = spark.createDataFrame(
        [(i, y) for i, _, y in rows] + [(None, 1), (5000, None), (3, 0), (3, 0)], "doc_id long, toxic int"
    )
    model = tox.train(docs, labels, F.lit(True))
    got = tox.score(docs, model).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.score <= 1
        by[r.doc_id].append(r.score)
    assert by[5000] == by[5001]
    assert by[4][0] == by[4][1] > 0.3
    assert tox.score(docs.limit(0), model).collect() == []
    none = tox.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in tox.score(docs, none).collect()} == {0.0}
    kept = tox.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_again_the_same(spark):
    rows = corpus(120, 3)
    assert np.array_equal(model_of(rows).curve, model_of(rows).curve)


def test_memory_is_bound_by_bytes():
    class Lengths:
        bias = 0.5

        def word_scores(self, words):
            return np.array([float(len(w)) for w in words])

    memory = tox.Memory(Lengths(), 1000)
    for words in (["a", "bb", "a"], ["x" * 5000, "bb"], [], ["c" * i for i in range(1, 30)], ["a"]):
        scores, bias = memory(words)
        assert scores.tolist() == [len(w) for w in words] and bias == 0.5
    assert list(memory.known) == ["a"] and memory.held == 1 + tox.ENTRY
