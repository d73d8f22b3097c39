import random
import re
import string
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from labelwright.llm import minhash
from labelwright.llm.components import components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """Smallest reachable id per row, by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return [(doc, len(sets[i]), min(least[find(i)], default=None) if sets[i] else doc)
            for i, (doc, _) in enumerate(rows)]


def words(rng, n):
    return ["".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 7))) for _ in range(n)]


def corpus():
    rng = random.Random(9)
    texts = [" ".join(words(rng, 60)) for _ in range(60)]
    base = words(rng, 120)
    for _ in range(60):  # copies of a template, each changed in two or three places
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3])):
            copy[at] = "x" + str(rng.randrange(10**6))
        texts.append(" ".join(copy))
    texts.append(" ".join(base))
    passage = words(rng, 40)
    for _ in range(40):  # documents that share a passage and are no copies
        texts.append(" ".join(words(rng, 45) + passage))
    for k in range(12):  # pairs near the threshold, among those that share the passage
        own = words(rng, 40 + k) + passage
        twin = list(own)
        twin[3] = "other"
        twin[20] = "words"
        texts += [" ".join(own), " ".join(twin)]
    texts += ["one two", "ONE\ttwo ", "one two three", "", None, " \n", "a b c d e", "A B C D E", "é É", "É É"]
    texts += [texts[0]] * 5 + ["loop " * 3000, "loop " * 500, " ".join(words(rng, 20000))]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[3]), (None, "null id only text with words"), (None, "null id only text with words")]


def test_equals_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, kept string, node int")
    got = minhash.near_duplicates(df.repartition(4))
    assert got.columns == ["doc_id", "node", "n_shingles", "component_id", "kept", "component"]
    found = got.collect()
    assert sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id) for r in found])) == sorted(map(str, brute(rows)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(blank).collect()) == [(1, 1, True), (2, 2, True)]


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    own = words(rng, 2000)
    hashed, upto = minhash.shingles(pa.array([" ".join(own), " ".join(own[:1000]), "", " ".join(own)]))
    sig = minhash.signatures(hashed, upto)
    assert sig.shape == (3, minhash.VALUES)
    assert (sig[0] == sig[2]).all()
    assert (sig[0] == sig[1]).mean() == pytest.approx(0.5, abs=0.2)
    assert np.diff(upto).tolist() == [1996, 996, 0, 1996]


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(2)
    ids = rng.sample(range(-(10**12), 10**12), 400)
    chain = list(zip(ids[:150], ids[1:151]))
    star = [(ids[200], x) for x in ids[201:300]]
    links = chain + star + [(ids[301], ids[302]), (ids[302], ids[301]), (ids[303], ids[303])]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {x: min(ids[:151]) for x in ids[:151]} | {x: min(ids[200:300]) for x in ids[200:300]}
    want |= {ids[301]: min(ids[301:303]), ids[302]: min(ids[301:303])}
    assert got == want


def family(rng, copies, edits, size=200):
    """Copies of a template that is not there, each with ``edits`` words changed, and their components."""
    base = words(rng, size)
    texts, missing = [], np.zeros((copies, size - 4), bool)
    for i in range(copies):
        copy = list(base)
        for at in rng.sample(range(size), rng.choice(edits)):
            copy[at] = f"x{i}y{at}"
            missing[i, max(0, at - 4) : at + 1] = True
        texts.append(" ".join(copy))
    both = (~missing).astype(int) @ (~missing).T.astype(int)
    near = 100 * both >= 75 * (2 * (size - 4) - both)
    least = np.arange(copies)
    while True:
        now = np.where(near, least[None, :], copies).min(axis=1)
        if (now == least).all():
            return texts, least.tolist()
        least = now


def test_family_without_its_template(spark):
    texts, want = family(random.Random(21), 2000, [4])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(minhash.near_duplicates(df).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(want))] == want


def test_copies_of_a_template_have_few_candidates_and_none_twice(spark, monkeypatch):
    rng = random.Random(4)
    base = words(rng, 200)
    texts = [" ".join(base)]
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(200), 2):
            copy[at] = f"x{i}y{at}"
        texts.append(" ".join(copy))
    passage = words(rng, 120)
    texts += [" ".join(words(rng, 50) + passage) for _ in range(60)]
    tested, confirmed = [], minhash._confirmed

    def recorded(pairs, sets):
        tested.extend(tuple(r) for r in pairs.select("a", "b").collect())
        return confirmed(pairs, sets)

    monkeypatch.setattr(minhash, "_confirmed", recorded)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(minhash.near_duplicates(df).select("doc_id", "component_id").collect())
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == i for i in range(301, 361))
    assert len(tested) == len(set(tested))


def test_sets_are_read_only_for_pairs_that_are_confirmed(spark, monkeypatch):
    texts, want = family(random.Random(8), 300, [3, 4, 5])
    texts += family(random.Random(9), 60, [5])[0]
    unneeded, confirmed = [], minhash._confirmed

    def recorded(pairs, sets):
        needed = {node for pair in pairs.select("a", "b").collect() for node in pair}
        unneeded.append(len({r.node for r in sets.select("node").collect()} - needed))
        return confirmed(pairs, sets)

    monkeypatch.setattr(minhash, "_confirmed", recorded)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(minhash.near_duplicates(df).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(want))] == want
    assert len(unneeded) > 2 and not any(unneeded)


def test_sorted_neighbours_over_cuts(spark, monkeypatch):
    """Partitions of a few rows compare the same pairs as one partition."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 31, minhash.VALUES, dtype=np.int64)
    sig = np.where(rng.random((60, minhash.VALUES)) < 0.2, rng.integers(0, 1 << 31, (60, minhash.VALUES)), base)
    rows = spark.createDataFrame(
        [(i, s, (1 << minhash.TREES) - 1, i // 3) for i, s in enumerate(sig.tolist())],
        "node long, sig array<int>, trees int, family long",
    )
    whole = sorted(map(tuple, minhash.sorted_pairs(rows, 0).select("a", "b").collect()))
    monkeypatch.setattr(minhash, "ROWS_PER_SORT_PART", 100)
    cut = sorted(map(tuple, minhash.sorted_pairs(rows, 0).select("a", "b").collect()))
    assert whole and set(whole) <= set(cut)
    assert all(a // 3 != b // 3 for a, b in cut)


def test_scratch_is_given_back_on_the_way(spark, monkeypatch):
    """Signatures lie in one table at a time, and sets and levels go when they have been used."""
    held, peak = set(), []
    spool, release = minhash.spool, minhash.release

    def watched(df, name="spool"):
        held.add(name)
        peak.append({"sketches", "signed", "dense", "sets", "level"} & held)
        return spool(df, name)

    def released(*tables):
        release(*tables)
        for df in tables:
            held.discard(df.spooled_at.rsplit("/", 1)[1].rsplit("-", 1)[0])

    monkeypatch.setattr(minhash, "spool", watched)
    monkeypatch.setattr(minhash, "release", released)
    words = [f"w{i}" for i in range(60)]
    data = [(i, " ".join(words[:40] + [words[40 + i % 3]])) for i in range(9)] + [(9, " ".join(words[::-1]))] * 2
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "component_id").collect())) == [(i, 0) for i in range(9)] + [(9, 9)] * 2
    assert not {"signed", "sets", "level", "regions", "crowd", "needed"} & held
    assert all(not ({"level", "sets"} <= p or {"signed", "sets"} <= p) for p in peak)
