import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import labelwright.llm.divergence as divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, P int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def documents(seed=1):
    rng = random.Random(seed)
    words = ["a", "The", "über", "ÜBER", "x" * 8, "x" * 9, "y" * 16, "y" * 17, "zwölfzwölfzwölf", "🙂", " ", "Q" * 40]
    words += ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 20))) for _ in range(120)]
    out = []
    for i in range(400):
        source = rng.choice(["hot", "hot", "hot", "s1", "s2", "", None, "ß"])
        chosen = rng.choices(words, range(1, len(words) + 1), k=rng.randint(0, 30))
        joint = "".join(w + rng.choice([" ", ".", "\n", "7", "@", "[", "{", "\x7f"]) for w in chosen)
        out.append((i, joint, rng.choice(["en", "en", "de", None]), source, "t", 1))
    out += [(900, None, "en", "silent", "t", 1), (901, "once only", "fr", "alone", "t", 1), (902, "", "fr", "other", "t", 1)]
    out += [(903, "same same", "it", "one", "t", 1)] * 3 + [(904, "b" * 300_000 + " end", "en", "s1", "t", 1)] * 3
    return out


def expected(rows):
    held, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        held[lang, source].update(found)
        docs[lang].update(set(found))
        groups.add((lang, source))
    kept = {lang: sorted(t for t, n in docs[lang].items() if n >= 3) for lang in {g[0] for g in groups}}

    def shares(counts, terms):
        total = sum(counts[t] for t in terms)
        return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(terms)) for t in terms}

    p = {g: shares(held[g], kept[g[0]]) for g in groups}
    out = set()
    for lang, source in groups:
        mine, terms = p[lang, source], kept[lang]
        whole = sum((held[g] for g in groups if g[0] == lang), Counter())
        q = shares(whole, terms)
        pairs = [(-sum((mine[t] - p[lang, other][t]) ** 2 // p[lang, other][t] for t in terms), other.encode(), other)
                 for place, other in groups if place == lang and other != source]
        ranked = [("pair", *x) for x in enumerate(sorted(pairs), 1)]
        found = [(-((mine[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in terms if held[lang, source][t] and mine[t] > q[t]]
        ranked += [("term", *x) for x in enumerate(sorted(found), 1) if x[0] <= 200]
        out |= {(lang, source, part, item, -value, rank) for part, rank, (value, _, item) in ranked}
    return out


def audited(spark, rows, parts=4):
    got = [tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_brute_force(spark):
    rows = documents()
    want = expected(rows)
    assert audited(spark, rows) == want
    assert any(part == "pair" and value == 0 and lang == "fr" for lang, _, part, _, value, _ in want)


def test_small_slices_and_held_pairs_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_PAIRS", 1)
    monkeypatch.setattr(divergence.small_slices, "__defaults__", (200, 3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert audited(spark, documents(2)) == expected(documents(2))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_only_top_terms(spark):
    words = ["".join(chr(97 + d) for d in divmod(i, 26)) for i in range(26 * 26)]
    rows = [(i, " ".join(words[:300]), "en", "a", "t", 1) for i in range(3)] + [(9, " ".join(words), "en", "b", "t", 1)] * 3
    got = audited(spark, rows)
    assert got == expected(rows) and max(r[5] for r in got if r[2] == "term") == 200


def test_shares_hold_large_counts(spark):
    n = 9_000_000_000_000_000_000
    df = spark.createDataFrame([(n, n, 5), (0, n, 5)], "n long, total long, v long")
    got = [r[0] for r in df.select(divergence._share(df.n, df.total - 5, df.v)).collect()]
    assert got == [1 + 10**9 * (n + 1) // n, 1 + 10**9 // n]


@pytest.mark.parametrize("words", [1, 2])
def test_radix_order_is_stable(words):
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 2**64, 500, np.uint64) >> np.uint64(rng.choice([0, 20, 60])) for _ in range(words)]
    keys = [np.concatenate([k, k]) for k in keys]
    want = sorted(range(1000), key=lambda i: (*(int(k[i]) for k in keys), i))
    assert divergence.radix_order(keys).tolist() == want


def test_buckets_of_one_slice():
    text = "Aa aa " + "B" * 16 + " " + "b" * 17 + " " + "b" * 16
    batch = pa.RecordBatch.from_pydict({"lang": ["l", None], "source": ["s", "s"], "text": [text, "aa\x00" + "b" * 17]})
    rows = [tuple(r.values()) for out in divergence._slice_counts(batch) for r in out.to_pylist()]
    assert sorted(rows) == sorted([
        ("l", "s", "aa", 2, 1), ("l", "s", "b" * 16, 2, 1), ("l", "s", "b" * 17, 1, 1), ("", "s", "aa", 1, 1), ("", "s", "b" * 17, 1, 1),
    ])


def test_no_task_has_all_of_a_hot_source(spark, physical_plan):
    counts = divergence.count_terms(spark.createDataFrame(documents(), SCHEMA))
    plan = physical_plan(counts)
    assert "partial_sum" in plan and "hashpartitioning(lang" in plan and "term" in plan


def test_empty_table(spark):
    assert audited(spark, []) == set()
