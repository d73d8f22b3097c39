import random
from collections import Counter

import numpy as np
import pytest

from labelwright.llm import suffixes

DEPTH = suffixes.DEPTH


def brute(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + DEPTH] for d in data for i in range(len(d) - DEPTH + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - DEPTH + 1):
            if count[d[i : i + DEPTH]] > 1:
                gone[i : i + DEPTH] = b"\1" * DEPTH
        left = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len([1 for x in bytes(gone).split(b"\0") if x]), left))
    return out


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeé🙂", k=rng.randrange(1, 8))) for _ in range(n))


def corpus():
    rng = random.Random(8)
    passage = words(rng, 150)
    exact = passage.encode()[: DEPTH].decode(errors="ignore")
    texts = [words(rng, rng.randrange(20, 400)) for _ in range(25)]
    texts += [words(rng, 50) + passage + words(rng, 50) for _ in range(12)]
    texts += [words(rng, 9) + passage[rng.randrange(100) : rng.randrange(300, 700)] for _ in range(25)]
    base = words(rng, 500)
    for _ in range(20):  # copies with edits here and there
        copy = base
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(copy))
            copy = copy[:at] + "#" + str(rng.random()) + copy[at + rng.randrange(3) :]
        texts.append(copy)
    texts += [None, "", "short", "a" * 399, "a" * 400, "ab" * 900, "ab" * 1000 + "c", exact, exact + "x", "x" + exact]
    texts += ["z" * 401, texts[3], texts[3], "q" + texts[4]]
    texts += [base[:300] + "!" + base[300:], "\n".join([words(rng, 60)] * 20)]
    return texts


def test_equals_brute_force(spark):
    texts = corpus()
    data = [(i, t, b"mine", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, Kept binary, _t1 int")
    got = suffixes.without_repeats(df.repartition(5)).collect()
    want = brute(texts)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], texts[r.doc_id]
        assert r._t1 == 0


def test_repeated_rows_and_null_ids(spark):
    text = words(random.Random(1), 300)
    df = spark.createDataFrame([(None, text), (None, text), (5, text + "x"), (5, None)], "doc_id long, text string")
    got = suffixes.without_repeats(df).collect()
    assert sorted((r.n_removed, r.n_bytes) for r in got) == sorted(
        (a[1], a[0]) for a in brute([text, text, text + "x", None])
    )


def test_empty_table(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_texts_are_cut_into_whole_suffixes():
    rng = random.Random(3)
    data = bytes(rng.choices(b"abc ", k=9000))
    long, short = suffixes.runs([data], piece=1000), suffixes.runs([data])
    for found in (long, short):
        places = np.concatenate([np.arange(a, b + 1) for a, b in zip(found["low"], found["high"])])
        assert sorted(places.tolist()) == list(range(9000 - DEPTH + 1))

    def by_suffix(found):
        return {i: (int(p) - i, int(h)) for a, b, p, h in
                zip(found["low"], found["high"], found["place"], found["anchor"]) for i in range(a, b + 1)}

    assert by_suffix(long) == by_suffix(short)


def test_hashes_of_substrings():
    data = b"abcabcabc" * 100
    hasher = suffixes.Hasher(data)
    a, b = hasher.of(np.array([0, 3, 1]), np.array([500, 503, 501])), hasher.every(500)
    assert a[0] == a[1] == b[0] == b[3] and a[0] != a[2] == b[1]
    assert suffixes._sliding_least(np.array([5, 3, 4, 1, 9], np.uint64), 2).tolist() == [3, 3, 1, 1]


@pytest.mark.parametrize("lows,highs", [([0], [0]), ([0, 500], [10, 500]), ([100, 120], [100, 130])])
def test_without(lows, highs):
    text = bytes(range(256)) * 4
    gone = set()
    for a, b in zip(lows, highs):
        gone |= set(range(a, b + DEPTH))
    left, removed, spans = suffixes.without(text, np.array(lows), np.array(highs))
    assert left == bytes(x for i, x in enumerate(text) if i not in gone) and removed == len(gone)
    assert spans == sum(1 for i in gone if i - 1 not in gone)
