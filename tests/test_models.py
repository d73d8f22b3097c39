"""Vectors, folds, models and metrics on a small separable text."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from labelwright.models import classifier, folds, linear
from labelwright.models.stages import TfidfVectorizer
from labelwright.operators import features, metrics, sampling
from labelwright.plans import comparison
from labelwright.plans.noise import detect_noise, noise_split
from labelwright.plans.out_of_domain import ood_funnel, prepare_ood

CLASSES = (1.0, 5.0)
TRAINING = {"classes": CLASSES, "max_features": 200, "max_iter": 10}


@pytest.fixture(scope="module")
def reviews(spark):
    """Two classes with their own words; every 20th label is turned round."""
    source = random.Random(3)
    words = {1.0: ["bad", "broken", "awful", "noise"], 5.0: ["great", "lovely", "superb", "joy"]}
    rows = []
    for i in range(240):
        true = 5.0 if i % 3 else 1.0
        text = " ".join(source.choices(words[true] + ["disc", "track", "album"], k=12)) + f" n{i % 60}"
        rows.append((i, text, true if i % 20 else 6.0 - true))
    return spark.createDataFrame(rows, "id bigint, text string, rating double").coalesce(2)


@pytest.mark.parametrize("n_max", [1, 2])
def test_vectors_equal_the_relational_weights(reviews, n_max):
    model = TfidfVectorizer("id", n_max=n_max, max_features=50).fit(reviews)
    terms = model.stages[1].vocabulary
    vectors = {
        r.id: {terms[i]: v for i, v in zip(r.features["indices"], r.features["values"])}
        for r in model.transform(reviews).collect()
    }
    table = {}
    for r in features.tfidf(reviews, "id", n_max=n_max, max_features=50).collect():
        table.setdefault(r.id, {})[r.term] = r.weight
    assert vectors.keys() == table.keys()
    for row_id, weights in table.items():
        assert vectors[row_id] == pytest.approx(weights)
        assert math.isclose(sum(w * w for w in weights.values()), 1.0)


def test_vocabulary_ties_and_minimum(spark):
    texts = ["bb aa aa", "bb aa", "cc dd dd dd", "cc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    words = features.vocabulary(features.term_counts(df, "id"), max_features=2)
    assert [(r.term, r.total, r.df) for r in words.orderBy(F.desc("total"), "term").collect()] == [
        ("aa", 3, 2), ("bb", 2, 2),
    ]


def test_texts_are_tokenised_once_per_pass(reviews, physical_plan):
    plan = physical_plan(features.term_counts(reviews, "id"))
    assert plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("max_features, min_docs", [(5, 2), (12, 1), (500, 2)])
def test_vocabulary_by_buckets_equals_the_whole_count(spark, reviews, monkeypatch, max_features, min_docs):
    """Few buckets, ties at the border, repeated ids: the same rows in the same order."""
    rows = reviews.union(reviews.filter("id < 30"))
    whole = features.vocabulary(features.term_counts(rows, "id", n_max=2), max_features, min_docs).collect()
    monkeypatch.setattr(features, "WHOLE_BYTES", 0)
    for buckets in (3, 64, 1 << 20):
        monkeypatch.setattr(features, "BUCKETS", buckets)
        got = features.corpus_vocabulary(rows, "id", "text", 2, max_features, min_docs).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in whole]


@pytest.mark.parametrize("n_max", [1, 2])
def test_buckets_are_counted_without_joining_tokens(spark, reviews, physical_plan, n_max):
    """Tokens by place, no strings made of pairs; one token, none and a null text included."""
    rows = reviews.select("id", "text").union(
        spark.createDataFrame([(900, "lonely"), (901, "- !"), (902, None)], "id bigint, text string")
    )
    found = features.occurrences(rows, "text", n_max)
    plan = physical_plan(found.groupBy("bucket").count())
    assert "concat_ws" not in plan
    got = found.groupBy("id", F.concat_ws(" ", "_first", "_second").alias("term")).count()
    want = features.term_counts(rows, "id", n_max=n_max)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_weights_do_not_depend_on_how_terms_were_counted(reviews, monkeypatch):
    def rows():
        return sorted(map(tuple, features.tfidf(reviews, "id", n_max=2, max_features=20).collect()))

    whole = rows()
    monkeypatch.setattr(features, "WHOLE_BYTES", 0)
    monkeypatch.setattr(features, "PART_BYTES", features.text_bytes(reviews) // 20)
    got = rows()
    assert [r[:2] for r in got] == [r[:2] for r in whole]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in whole])


def test_parts_of_term_counts_follow_the_size_of_the_texts(spark, reviews, monkeypatch):
    monkeypatch.setattr(features, "PART_BYTES", features.text_bytes(reviews) // 40)
    assert features.term_counts(reviews, "id").rdd.getNumPartitions() >= 40


def test_folds_are_stratified(reviews):
    placed = folds.assign_folds(reviews, "id")
    sizes = {(r.rating, r.fold): r["count"] for r in placed.groupBy("rating", "fold").count().collect()}
    for label in CLASSES:
        counts = [n for (other, _), n in sizes.items() if other == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_folds_of_a_tiny_class(spark):
    df = spark.createDataFrame([(i, "t", 1.0) for i in range(3)], "id int, text string, rating double")
    assert sorted(r.fold for r in folds.assign_folds(df, "id").collect()) == [0, 1, 2]


def _dense(seed, n, d, n_classes):
    source = np.random.default_rng(seed)
    x = source.normal(size=(n, d)) * (source.random((n, d)) < 0.6)
    y = (np.abs(x[:, 0] * 2 + source.normal(size=n)) % n_classes).astype(int)
    return x, y


def _packed(spark, x, y, members):
    rows = [
        ((np.flatnonzero(row).tolist(), row[np.flatnonzero(row)].tolist()), int(label), models)
        for row, label, models in zip(x, y, members)
    ]
    schema = "features struct<indices:array<int>,values:array<double>>, target int, models array<int>"
    return linear.pack(spark.createDataFrame(rows, schema).repartition(5), 1 + max(map(max, members)))


@pytest.mark.parametrize("loss, n_classes", [("logistic", 2), ("logistic", 3), ("hinge", 3)])
def test_all_models_reach_their_optimum_in_shared_passes(spark, monkeypatch, loss, n_classes):
    """The gradient of each model's objective vanishes at its fit, on its own rows."""
    monkeypatch.setattr(linear, "FAN_IN", 2)
    monkeypatch.setattr(linear, "BLOCK_ROWS", 16)
    x, y = _dense(5, 90, 6, n_classes)
    x[7] = 0.0
    members = [[m for m in range(3) if i % 3 != m] for i in range(len(x))]
    shape = linear.Shape(loss, 3, n_classes, 6, 0.5)
    weights, passes = linear.fit(_packed(spark, x, y, members), shape, 1000, 1e-9)
    assert passes < 80
    one = np.hstack([x, np.ones((len(x), 1))])
    for model in range(3):
        own = np.array([model in m for m in members])
        w = weights[:, model * shape.outputs:(model + 1) * shape.outputs]
        scores, held = one @ w, w.copy()
        if loss == "hinge":
            sign = np.where(y[:, None] == np.arange(n_classes), 1, -1)
            slope = -2 * sign * np.maximum(0, 1 - sign * scores)
        else:
            held[-1] = 0
            if n_classes == 2:
                slope = 1 / (1 + np.exp(-scores)) - y[:, None]
            else:
                p = np.exp(scores - scores.max(axis=1, keepdims=True))
                slope = p / p.sum(axis=1, keepdims=True) - np.eye(n_classes)[y]
        assert np.abs(held + 0.5 * one[own].T @ slope[own]).max() < 1e-6


def test_an_uneven_problem_is_fitted_in_few_passes(spark):
    """With 30 steps remembered, this one took 260 passes."""
    source = np.random.default_rng(3)
    x = source.normal(size=(150, 100)) * np.arange(1, 101) ** -0.5
    y = (x @ source.normal(size=100) * 3 + source.normal(size=150) > 0).astype(int)
    shape = linear.Shape("hinge", 1, 2, 100, 10.0)
    weights, passes = linear.fit(_packed(spark, x, y, [[0]] * 150), shape, 2000, 1e-8)
    assert passes < 180
    one, sign = np.hstack([x, np.ones((150, 1))]), 2 * y - 1
    short = np.maximum(0, 1 - sign * (one @ weights[:, 1]))
    assert np.abs(weights[:, 1] - 20.0 * one.T @ (sign * short)).max() < 1e-5


def test_the_memory_of_a_fit_is_bounded():
    wide = linear.Shape("hinge", 4, 5, 10_000, 1.0)
    assert linear._memory(linear.Shape("hinge", 1, 2, 10_000, 1.0)) == linear.MEMORY
    assert linear.LEAST_MEMORY <= linear._memory(wide) < linear.MEMORY
    assert linear._memory(wide) * 16 * 10_001 * 20 <= linear.MEMORY_BYTES


def test_squared_hinge_optimum_in_closed_form(spark):
    """Two rows inside the margin: the optimum solves a 2 x 2 system."""
    shape = linear.Shape("hinge", 1, 2, 1, 1.0)
    weights, _ = linear.fit(_packed(spark, np.array([[1.0], [-0.5]]), [1, 0], [[0], [0]]), shape, 100, 1e-12)
    # (1 + 2 sum x^2) w + 2 sum x b = 2 sum x y, and 2 sum x w + (1 + 2 n) b = 2 sum y.
    w, b = np.linalg.solve([[3.5, 1.0], [1.0, 5.0]], [3.0, 0.0])
    assert weights[:, 1] == pytest.approx([w, b]) and weights[:, 0] == pytest.approx([-w, -b])


def test_models_run_no_python_by_row(reviews, physical_plan):
    model = classifier.train_text_classifier(reviews, "id", **TRAINING)
    assert "Python" not in physical_plan(classifier.predict(model, reviews, CLASSES))


def test_relational_scorer_equals_the_pipeline(spark, reviews):
    empty = spark.createDataFrame([(900, "", 1.0), (901, "zzz qqq", 5.0)], reviews.schema)
    rows = reviews.union(empty)
    model = classifier.train_text_classifier(reviews, "id", **TRAINING)
    weights = classifier.weights_table(model, spark, CLASSES)
    scores = linear.relational_scores(classifier.weighted_terms(model, rows, "id"), weights, rows, "id")
    assert scores.count() == rows.count() * 2
    relational = {r.id: r.prediction for r in linear.best_class(scores, "id").collect()}
    assert relational == {r.id: r.prediction for r in classifier.predict(model, rows, CLASSES).collect()}


def test_a_class_without_rows_is_never_predicted(reviews):
    model = classifier.train_text_classifier(reviews, "id", **TRAINING | {"classes": (1.0, 3.0, 5.0)})
    got = {r.prediction for r in classifier.predict(model, reviews, (1.0, 3.0, 5.0)).collect()}
    assert got == {1.0, 5.0}


def test_noise_is_found(reviews):
    scored = detect_noise(reviews, "id", classes=CLASSES, frac_noise=1.0, max_features=200, max_iter=20, min_docs=2)
    rows = scored.collect()
    assert sorted(r.id for r in rows) == list(range(240))
    noisy, clean = noise_split(scored)
    found = {r.id for r in noisy.collect()}
    turned = set(range(0, 240, 20))
    assert len(found & turned) >= 4 and len(found - turned) <= 2
    assert noisy.count() + clean.count() == 240
    assert all(r.suggested_rating != r.rating for r in rows if r.is_label_issue)


def test_repeated_and_missing_ids_lose_no_row(spark, reviews):
    """Ids under two classes and null ids: every row is fitted or scored besides, once."""
    twice = reviews.filter("id < 60").withColumn("rating", 6.0 - F.col("rating"))
    nameless = reviews.filter("id < 50").withColumn("id", F.lit(None).cast("bigint"))
    rows = reviews.union(twice).union(nameless)
    scored = detect_noise(rows, "id", classes=CLASSES, max_per_class=20, max_features=200, max_iter=5)
    assert scored.count() == 350
    want = rows.groupBy("id", "rating").count()
    assert scored.groupBy("id", "rating").count().exceptAll(want).count() == 0
    chosen, others = sampling.split_per_class(rows, 20, "id")
    assert chosen.filter("id IS NULL").count() == 0 and chosen.count() >= 40
    assert chosen.count() + others.count() == 350


def test_probabilities_sum_to_one_and_cover_absent_classes(reviews):
    scored = folds.oof_probabilities(reviews, "id", classes=(1.0, 3.0, 5.0), max_iter=5, max_features=100)
    rows = scored.collect()
    assert len(rows) == 240 and {len(r.p) for r in rows} == {3}
    assert all(math.isclose(sum(r.p), 1.0, abs_tol=1e-9) for r in rows)
    assert {r.label_index for r in rows} == {0, 2}


def test_reloaded_model_predicts_the_same(reviews, tmp_path):
    train, test = reviews.filter("id < 160"), reviews.filter("id >= 160")
    model = classifier.train_text_classifier(train, "id", **TRAINING)
    model.write().save(str(tmp_path / "model"))
    before = {r.id: r.prediction for r in classifier.predict(model, test, CLASSES).collect()}
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert {r.id: r.prediction for r in classifier.predict(loaded, test, CLASSES).collect()} == before
    right = sum(before[i] == (5.0 if i % 3 else 1.0) for i in before)
    assert right / len(before) > 0.9
    cells = classifier.evaluate_ood(str(tmp_path / "model"), test, classes=CLASSES)
    assert metrics.overall_scores(cells).first().n == len(before)


def test_comparison_end_to_end(reviews, tmp_path):
    clean = reviews.withColumn("rating", F.when(F.col("id") % 3 == 0, 1.0).otherwise(5.0))
    test = comparison.fixed_test_set(clean, "id", per_class=30)
    variants = comparison.build_variants(reviews.union(reviews.withColumn("id", F.col("id") + 1000)), reviews, clean, test, "id")
    test_texts = {r.text for r in test.collect()}
    for frame in variants.values():
        assert not test_texts & {r.text for r in frame.collect()}
    results = comparison.compare_variants(variants, test, "id", model_path=str(tmp_path / "m"), **TRAINING)
    rows = {r.experiment: r for r in results.collect()}
    assert tuple(sorted(rows)) == tuple(sorted(comparison.VARIANTS))
    assert rows["V1_corrected"].f1_macro > 0.9
    assert [r.effect for r in comparison.effects(results).collect()] == list(comparison.EFFECTS)
    PipelineModel.load(str(tmp_path / "m"))


def test_no_effect_on_a_base_of_zero(spark):
    rows = [(name, score) for name, score in zip(comparison.VARIANTS, (0.0, 0.0, 0.5, 0.25))]
    got = comparison.effects(spark.createDataFrame(rows, "experiment string, f1_macro double")).collect()
    assert [(r.delta_f1, r.delta_pct) for r in got] == [(0.0, 0.0), (0.5, 0.0), (-0.25, -50.0)]


def test_zero_division_scores_zero(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (2.0, 3.0)], "rating double, prediction double")
    scores = {r["class"]: r for r in metrics.class_scores(metrics.confusion(df)).collect()}
    assert (scores[2.0].precision, scores[2.0].recall, scores[2.0].f1) == (0.0, 0.0, 0.0)
    assert (scores[3.0].support, scores[3.0].f1) == (0, 0.0)
    overall = metrics.overall_scores(metrics.confusion(df)).first()
    assert overall.accuracy == pytest.approx(1 / 3) and overall.f1_macro == pytest.approx((2 / 3) / 3)


def test_bad_first_copy_hides_a_good_one(spark):
    hotels = spark.createDataFrame(
        [(1, "same hotel text", "{'overall': 3.7}"), (2, "same hotel text", "{'overall': 4.0}"),
         (3, "another hotel text", "{'overall': 5.0}"), (4, "short", "{'overall': 5.0}"),
         (5, None, "{'overall': 5.0}"), (6, "no rating in here", "{'rooms': 1.0}")],
        "id int, title string, ratings string",
    )
    assert [(r.id, r.rating) for r in prepare_ood(hotels, "id").collect()] == [(3, 5.0)]
    assert [r.kept for r in ood_funnel(hotels, "id").orderBy("step").collect()] == [6, 5, 4, 3, 1, 1]


def test_two_hinge_classes_are_fitted_once(spark, monkeypatch):
    """One problem for two classes; a pass computes only the problems that are still asked for."""
    shape = linear.Shape("hinge", 2, 2, 6, 1.0)
    assert len(shape.problems) == 2
    x, y = _dense(3, 60, 6, 2)
    members = [[0] if i % 4 else [0, 1] for i in range(len(x))]
    asked, one_pass = [], linear.one_pass
    monkeypatch.setattr(
        linear, "one_pass", lambda blocks, shape, weights, live: asked.append(live) or one_pass(blocks, shape, weights, live)
    )
    weights, passes = linear.fit(_packed(spark, x, y, members), shape, 1000, 1e-9)
    assert weights.shape == (7, 4) and np.array_equal(weights[:, 0], -weights[:, 1])
    assert len(asked) == passes and asked[0] == [0, 1] and len(asked[-1]) == 1


def test_blocks_are_bounded_by_their_entries():
    lengths = np.array([0, 3, linear.BLOCK_ENTRIES + 1, 0, linear.BLOCK_ENTRIES, 1, *[0] * (linear.BLOCK_ROWS + 1)])
    cuts = list(linear._cuts(lengths))
    assert [rows for _, rows in cuts] == [2, 1, 2, linear.BLOCK_ROWS, 2]
    assert [start for start, _ in cuts] == [0, 2, 3, 5, 5 + linear.BLOCK_ROWS]
    assert list(linear._cuts(np.array([], np.int32))) == []


def test_wide_rows_fill_no_large_block_and_no_large_row_group(spark):
    """400 rows of 5,000 features are 24 MB of entries: they were one block, in one row group of one page."""
    features = F.struct(
        F.sequence(F.lit(0), F.lit(4_999)).alias("indices"),
        F.transform(F.sequence(F.lit(0), F.lit(4_999)), lambda i: F.rand(3) + i).alias("values"),
    )
    rows = spark.range(400).coalesce(1).select(
        features.alias("features"), F.lit(1).alias("target"), F.array(F.lit(0)).alias("models")
    )
    setting = spark.conf.get(linear._BATCH_SETTING)
    blocks = linear.pack(rows, 1)
    assert spark.conf.get(linear._BATCH_SETTING) == setting
    held = blocks.select("n", (F.octet_length("columns") / 4).alias("entries")).collect()
    assert sum(block.n for block in held) == 400 and sum(block.entries for block in held) == 2_000_000
    assert max(block.entries for block in held) <= linear.BLOCK_ENTRIES
    (path,) = [file.removeprefix("file://") for file in blocks.inputFiles()]
    found = pq.ParquetFile(path).metadata
    groups = [found.row_group(at) for at in range(found.num_row_groups)]
    assert max(group.total_byte_size for group in groups) <= 12 << 20


def test_a_fit_keeps_no_blocks_in_the_executors_memory(spark, monkeypatch):
    levels, one_pass = [], linear.one_pass
    monkeypatch.setattr(
        linear, "one_pass", lambda blocks, *rest: levels.append(blocks.getStorageLevel()) or one_pass(blocks, *rest)
    )
    x, y = _dense(3, 20, 6, 2)
    linear.fit(_packed(spark, x, y, [[0]] * 20), linear.Shape("hinge", 1, 2, 6, 1.0), 5)
    assert levels and all(level.useDisk and not level.useMemory for level in levels)
