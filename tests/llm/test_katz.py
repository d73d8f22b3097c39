import math
import random
import re
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelwright.llm import katz

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["</s>"]


def gt(counts, r):
    """Count r after discounting, from types per count."""
    if r > katz.RELIABLE:
        return r - katz.CONSTANT
    return r * katz.discounts(counts)[r - 1]


class Brute:
    def __init__(self, texts):
        self.one, self.two = Counter(), defaultdict(Counter)
        for text in texts:
            before = "<s>"
            for t in tokens(text):
                self.one[t] += 1
                self.two[before][t] += 1
                before = t
        self.n = sum(self.one.values())
        self.c1 = Counter(self.one.values())
        self.c2 = Counter(c for row in self.two.values() for c in row.values())
        self.unknown = 1 - sum(gt(self.c1, c) for c in self.one.values()) / self.n if self.n else 1.0
        self.seen = {}

    def p1(self, w):
        return gt(self.c1, self.one[w]) / self.n if w in self.one else self.unknown

    def p(self, w, u):
        row = self.two.get(u)
        if not row:
            return self.p1(w)
        total = sum(row.values())
        if w in row:
            return gt(self.c2, row[w]) / total
        if u not in self.seen:
            self.seen[u] = (1 - sum(gt(self.c2, c) for c in row.values()) / total) / (1 - sum(map(self.p1, row)))
        return self.seen[u] * self.p1(w)

    def score(self, text):
        before, out = "<s>", 0.0
        for t in tokens(text):
            out += math.log10(self.p(t, before))
            before = t
        return out

    def base(self, text):
        return sum(math.log10((self.one[t] + 1) / (self.n + len(self.one) + 1)) for t in tokens(text))


def corpus():
    rng = random.Random(7)
    vocabulary = ["w%d" % i for i in range(300)] + ["É", "é", "THE"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(60)))) for i in range(150)]
    rows += [(500 + i, "the same\tpassage  of words that is always the same") for i in range(20)]
    rows += [(700, None), (701, ""), (702, " \n"), (703, "never seen at all"), (704, "hot " * 4000),
             (rows[3][0], rows[3][1]), (rows[3][0], "same id other text"), (None, "no id at all"), (None, "no id at all")]
    return rows


def learned(doc):
    import zlib

    return doc is None or zlib.crc32(str(doc).encode()) % 7 != 2


def test_equals_brute_force_and_beats_the_base(spark, monkeypatch):
    monkeypatch.setattr(katz, "PART_BYTES", 4000)
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, Score string, n int")
    got, model = katz.score(df.repartition(3), F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    brute = Brute([t for d, t in rows if learned(d)])
    want = sorted(
        (d is None, d or 0, len(tokens(t)), sum(x in brute.one for x in tokens(t)), round(brute.base(t), 6), round(brute.score(t), 6))
        for d, t in rows
    )
    found = got.collect()
    assert sorted(
        (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in found
    ) == want
    assert got.columns == ["doc_id", "n", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert {r.train_tokens for r in found} == {brute.n}
    held = [r for r in found if not learned(r.doc_id) and r.n_tokens > 5]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    # Each context sums to 1, in the brute-force model and in the stored tables.
    for u in ["<s>", "the", "w0", "w250", "hot", "nowhere"]:
        assert sum(brute.p(w, u) for w in brute.one) + brute.p("\0", u) == pytest.approx(1)
    tables = spark.read.parquet(model.path + "/contexts")
    assert tables.count() == len(brute.two)
    assert sorted(r["count"] for r in tables.collect()) == sorted(sum(x.values()) for x in brute.two.values())
    assert all(r.weight > 0 for r in tables.collect())


def test_no_training_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in katz.score(df, F.lit(False))[0].collect()}
    assert got[1].score == 0.0 and got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].base_score == 0.0
    assert katz.score(df.limit(0), F.lit(True))[0].collect() == []


def test_discounts():
    assert katz.discounts({}) == [(r - 0.5) / r for r in range(1, 6)]
    d = katz.discounts({1: 1000, 2: 300, 3: 150, 4: 90, 5: 60, 6: 45})
    cut = 6 * 45 / 1000
    assert d[0] == pytest.approx((2 * 300 / 1000 - cut) / (1 - cut))
    assert all(0 < x < 1 for x in d)


def test_a_part_gets_only_the_texts_it_has_pairs_of(spark):
    """Keys of texts sent: at most one for each pair of a text, however many parts there are."""
    docs = spark.createDataFrame(
        [(i, True, f"w{i} w{i + 1} w{i} w{i + 1}") for i in range(500)], "row long, learn boolean, text string"
    ).coalesce(1)
    for parts in (4, 256):
        sent = katz._postings(docs, parts, {}).agg(
            F.sum(F.size("docs")).alias("keys"), F.sum(F.size("doc")).alias("pairs"),
        ).first()
        assert sent.pairs == 4 * 500  # start, w, w; w back; end
        assert sent.keys <= min(sent.pairs, 500 * parts)


def test_each_part_has_a_task_of_its_own(spark):
    docs = spark.createDataFrame(
        [(i, True, f"w{i} w{i + 1} x{i}") for i in range(300)], "row long, learn boolean, text string"
    ).coalesce(2)
    dealt = katz._dealt(katz._postings(docs, 40, {}), 40)
    tasks = dealt.select("part", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == 40 and len({r.task for r in tasks}) == len({r.part for r in tasks}) == 40


def test_hot_share_falls_with_the_parts():
    assert [katz.hot_words(p) for p in (1, 50, 1000, 10**7)] == [400, 400, 8000, 1 << 16]


def test_packed_numbers_come_back():
    import numpy as np

    for kind, top in ((np.int32, 2**31 - 1), (np.int64, 2**63 - 1)):
        values = np.concatenate([[0, 1, -1, top, -top - 1], np.arange(70_000) % 300]).astype(kind)
        cuts = np.array([0, 0, 3, 5, len(values), len(values)], np.int32)
        parts = katz._packed(values, cuts).to_pylist()
        assert len(parts) == 5
        got = [katz._unpacked(part, kind) for part in parts]
        assert all((g == values[a:b]).all() and g.dtype == kind for g, a, b in zip(got, cuts[:-1], cuts[1:]))
        assert len(parts[3]) < values.nbytes / 20


def test_pair_counts_are_kept_and_score_other_texts(spark, monkeypatch):
    monkeypatch.setattr(katz, "PART_BYTES", 4000)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scored, model = katz.score(df, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2)
    brute = Brute([t for i, t in rows if learned(i)])
    pairs = model.pairs(spark)
    assert pairs.count() == pairs.select("first", "second").distinct().count() == sum(map(len, brute.two.values()))
    assert Counter(r.n for r in pairs.collect()) == Counter(c for row in brute.two.values() for c in row.values())
    own = {(r.doc_id, round(r.score, 6)) for r in scored.collect()}
    assert {(r.doc_id, round(r.score, 6)) for r in katz.look_up(df, model).collect()} == own
    others = [(1, "w1 w0 unheard w2 THE of words"), (2, None), (3, "hot hot w5"), (4, "always always " * 30)]
    found = dict(katz.look_up(spark.createDataFrame(others, "doc_id long, text string"), model).collect())
    for i, text in others:
        assert math.isclose(found[i], brute.score(text), rel_tol=1e-9), i
    # Without training texts, every token is an unknown word.
    _, nothing = katz.score(df, F.lit(False))
    assert {r.score for r in katz.look_up(df, nothing).collect()} == {0.0}
