"""A third of the rows in one group, and plans that survive it."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from labelwright.operators import dedup, joins, position, profile, sampling

N = 3000


def digest(row_id, seed="42"):
    return hashlib.md5(f"{seed}:{row_id}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    """Text 'hot' and label 1 fill a third of the table each; some texts are null."""
    data = [
        (
            i,
            "hot" if i % 3 == 0 else None if i % 50 == 1 else f"text {i % 700}",
            1.0 if i % 3 == 1 else float(i % 5 + 1),
        )
        for i in range(N)
    ]
    df = spark.createDataFrame(data, "id bigint, text string, rating double")
    return df.repartition(7, "id"), data


def test_hot_keys_are_found_and_few(rows):
    df, _ = rows
    found = {r.text: r._salts for r in joins.hot_keys(df, "text", "id", 0.01, 1.0).collect()}
    share = 1000 / df.filter("text is not null").count()
    assert found == {"hot": math.ceil(share / 0.01)}


def test_hot_keys_from_a_sample(rows):
    df, _ = rows
    (found,) = joins.hot_keys(df, "text", "id", 0.01, 0.25).collect()
    assert found.text == "hot" and 25 <= found._salts <= 45
    assert joins.hot_keys(df, "text", "id", 0.01, 0.0).count() == 0


@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_salted_join_equals_plain_join(spark, rows, how):
    df, _ = rows
    right = df.filter("text is not null").select("text").distinct().filter(
        F.col("text").isin("hot", "text 5", "text 10", "text 77")
    ).withColumn("extra", F.length("text"))
    salted = joins.salted_join(df, right, "text", "id", how, share=0.01, rate=1.0)
    plain = df.join(right, "text", how)
    columns = plain.columns
    assert sorted(salted.select(*columns).collect(), key=str) == sorted(plain.collect(), key=str)


def test_hot_left_rows_go_to_many_partitions(rows):
    df, _ = rows
    right = df.filter("text = 'hot'").select("text").distinct().withColumn("extra", F.lit(1))
    joined = joins.salted_join(df, right, "text", "id", "left", share=0.01, rate=1.0)
    shuffled = joined.hint("merge").withColumn("part", F.spark_partition_id())
    spark = df.sparkSession
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in shuffled.filter("text = 'hot'").groupBy("part").count().collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(sizes) == N / 3 and len(sizes) == 8 and max(sizes) < N / 3 / 2


def test_dedup_prunes_before_the_shuffle(rows, physical_plan):
    df, data = rows
    unique = dedup.dedup_text_label(df, "id")
    first = {}
    for row in data:
        first.setdefault(row[1:], row[0])
    assert sorted(r.id for r in unique.collect()) == sorted(first.values())
    plan = physical_plan(unique)
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning(_w")
    assert "row_number(), 1, Partial" in plan


def test_duplicate_profile(rows):
    df, data = rows
    got = profile.duplicate_profile(df).first()
    assert got.dup_text_label == N - len({row[1:] for row in data})
    assert got.dup_text == N - len({row[1] for row in data})
    labels = {}
    for _, text, label in data:
        labels.setdefault(text, set()).add(label)
    assert got.conflict_texts == sum(len(s) > 1 for t, s in labels.items() if t is not None)


@pytest.mark.parametrize("cap", [1, 10, 400, 10_000])
def test_cap_per_class_equals_brute_force(rows, cap):
    df, data = rows
    expected = []
    for label in {row[2] for row in data}:
        members = sorted((digest(i), i) for i, _, other in data if other == label)
        expected += [i for _, i in members[:cap]]
    got = sampling.cap_per_class(df, cap, "id")
    assert sorted(r.id for r in got.collect()) == sorted(expected)


def test_sample_is_a_filter_without_shuffle(rows, physical_plan):
    df, _ = rows
    table = df.sparkSession.createDataFrame(df.limit(100).collect(), df.schema)
    plan = physical_plan(sampling.cap_per_class(table, 5, "id"))
    assert "Exchange" not in plan and "Window" not in plan


def test_samples_do_not_depend_on_partitions(rows):
    df, _ = rows
    ids = [
        sorted(r.id for r in sampling.cap_per_class(df.repartition(n), 50, "id").collect())
        for n in (1, 13)
    ]
    assert ids[0] == ids[1]


@pytest.mark.parametrize("edge_rows", [1_000_000, 0])
@pytest.mark.parametrize("quota", [1, 40, 1_500, 5_000])
def test_cuts_with_a_hot_id(spark, quota, edge_rows):
    """One id has a third of the rows; with ``edge_rows`` 0 buckets are divided once more."""
    data = [(7 if i % 3 == 0 else i, float(i % 2)) for i in range(N)]
    df = spark.createDataFrame(data, "id bigint, rating double").repartition(5)
    expected = {}
    for label in (0.0, 1.0):
        members = sorted((digest(i), i) for i, other in data if other == label)
        expected[label] = members[: quota][-1]
    assert sampling.class_cuts(df, quota, "id", "rating", "42", edge_rows) == expected


def test_a_hot_id_is_counted_before_the_shuffle(spark, tmp_path):
    """Rows shuffled while cuts are found: ids and buckets, not the copies of an id."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(7).alias("id"), F.lit(1.0).alias("rating"))
    df.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    (cut,) = sampling.class_cuts(stored, 100, "id", "rating", "42").values()
    copies = stored.groupBy("id").count().filter("count > 1").count()
    assert copies == 1 and cut == sorted((digest(i), i) for i in [7, *[i for i in range(60_000) if i % 3]])[99]


def test_quota_of_zero_and_unknown_class(rows):
    df, _ = rows
    got = sampling.sample_per_class(df, {2.0: 3, 9.0: 5}, "id")
    assert [r.rating for r in got.collect()] == [2.0] * 3
    assert sampling.sample_per_class(df, {}, "id").count() == 0
    assert sampling.sample_per_class(df, 0, "id").count() == 0


def test_matched_stratified_takes_what_there_is(rows):
    df, data = rows
    target = df.filter("rating in (1, 3)").union(df.filter("rating = 3"))
    got = {r.rating: r.n for r in profile.class_counts(sampling.matched_stratified(df, target, "id")).collect()}
    size = lambda label: sum(row[2] == label for row in data)
    assert got == {1.0: size(1.0), 3.0: size(3.0)}


def test_positions(rows):
    df, data = rows
    order = sorted((digest(i), i) for i, _, _ in data)
    expected = {i: place for place, (_, i) in enumerate(order)}
    got = {r.id: r.position for r in position.seeded_position(df, "id").collect()}
    assert got == expected


def test_rank_within_hot_ties(rows):
    df, data = rows
    ranked = position.rank_within(df, "rating", [F.col("id") % 1, "id"], "rank")
    expected = {}
    for label in {row[2] for row in data}:
        for place, i in enumerate(sorted(row[0] for row in data if row[2] == label), 1):
            expected[i] = place
    assert {r.id: r["rank"] for r in ranked.collect()} == expected


def test_assign_row_id_numbers_copies(spark):
    data = [("same", 1.0)] * 25 + [("other", None)] * 3 + [(None, None)]
    df = spark.createDataFrame(data, "text string, rating double")
    got = dedup.assign_row_id(df, copies_per_task=4)
    rows = got.collect()
    assert len(rows) == 29 and len({r.row_id for r in rows}) == 29
    assert sorted([(r.text, r.rating) for r in rows], key=str) == sorted(data, key=str)


def test_leakage_keeps_null_texts(rows):
    df, data = rows
    test = df.filter("text in ('hot', 'text 5')")
    expected = sum(row[1] not in ("hot", "text 5") for row in data)
    for buckets in (joins.FILTER_BUCKETS, 16, 1):
        kept = joins.remove_leakage(df, test, "id", buckets=buckets)
        assert kept.columns == df.columns and kept.count() == expected


def test_leakage_with_an_empty_side(spark, rows):
    df, _ = rows
    assert joins.remove_leakage(df, df.limit(0), "id").count() == N
    assert joins.remove_leakage(df, df.filter("text IS NULL"), "id").count() == N
    assert joins.remove_leakage(df.limit(0), df, "id").count() == 0


def test_bucket_filter_loses_and_doubles_no_row(rows, physical_plan):
    df, data = rows
    texts = {f"text {i}" for i in range(0, 700, 9)} | {"hot"}
    keys = df.filter(F.col("text").isin(*texts)).select("text").distinct()
    for buckets in (joins.FILTER_BUCKETS, 64, 1):
        likely, others = joins.split_by_bucket(df, keys, "text", buckets)
        inside, outside = ([r.id for r in part.collect()] for part in (likely, others))
        assert sorted(inside + outside) == list(range(N))
        assert {i for i, text, _ in data if text in texts} <= set(inside)
        assert {i for i, text, _ in data if text is None} <= set(outside)
    likely, others = joins.split_by_bucket(df, keys, "text")
    # Only the numbers of buckets move: no exchange by hash of the wide rows.
    assert "SortMergeJoin" not in physical_plan(others) and "BroadcastHashJoin" in physical_plan(others)


def test_metadata_needs_asin_and_one_more(spark, rows):
    df, _ = rows
    lookup = spark.createDataFrame([(1, "hot", "A1"), (2, "hot", "A2")], "m int, text string, asin string")
    assert joins.metadata_enrich(df, lookup, "id", "m") is df
    enriched = joins.metadata_enrich(df, lookup.withColumn("title", F.lit("T")), "id", "m")
    assert enriched.count() == N
    assert {r.asin for r in enriched.filter("text = 'hot'").collect()} == {"A1"}
