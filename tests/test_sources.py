import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from labelwright import contracts, session
from labelwright.operators.filters import filter_funnel, project_reviews, structural_stages
from labelwright.operators.profile import class_distribution, missing_profile
from labelwright.plans.ingest import ingest, ingest_funnel
from labelwright.sources import files

SCHEMA = "id bigint, text string, rating double"


def test_csv_round_trip_keeps_every_text(spark, tmp_path):
    texts = ['he said "no"', "two\nlines", " padded ", "a,b", "back\\slash", '"', "", "\\", 'end\\"', None]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], SCHEMA)
    files.sink_csv(df, str(tmp_path / "out"))
    back = files.scan_csv(spark, str(tmp_path / "out"), df.schema)
    expected = [t or None for t in texts]  # an empty text is a missing one
    assert [r.text for r in back.orderBy("id").collect()] == expected


def test_corrupt_json_lines_count_as_rows(spark, tmp_path):
    lines = ['{"text":"a","rating":4.0,"asin":"A","user_id":"U","other":1}', '{"text": "cut', '{"rating":"x","text":"b"}']
    (tmp_path / "raw.json").write_text("\n".join(lines))
    raw = files.scan_json(spark, str(tmp_path / "raw.json"))
    assert raw.count() == 3
    rows = {r.text: r.rating for r in project_reviews(raw).collect()}
    assert rows == {"a": 4.0, None: None, "b": None}


@pytest.mark.parametrize("scan", [
    lambda spark, path: files.scan_json(spark, path),
    lambda spark, path: files.scan_csv(spark, path, contracts.REVIEW),
])
def test_missing_input_stops_at_plan_time(spark, tmp_path, scan):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        scan(spark, str(tmp_path / "absent"))


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], SCHEMA)
    assert contracts.require_columns(df, ["text"]) is df
    with pytest.raises(ValueError, match="source"):
        contracts.require_columns(df, ["text", "source"])
    assert contracts.with_defaults(df, {"source": F.lit("unknown")}).first().source == "unknown"
    assert contracts.with_defaults(df, {"text": F.lit("no")}).first().text == "a"
    with pytest.raises(ValueError):
        contracts.first_present(df, ["title"])


def test_shared_root_is_the_session_setting(spark, monkeypatch):
    settings = spark.sparkContext.getConf().set("spark.checkpoint.dir", "/shared/place")
    monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda self: settings)
    assert session.shared_root(spark) == "/shared/place"


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    context = type(spark.sparkContext)
    monkeypatch.setattr(context, "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(context, "master", property(lambda self: "spark://host:7077"), raising=False)
    monkeypatch.setattr(context, "getConf", lambda self: {})
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_root(spark)


def test_ingest_is_one_scan_without_shuffle(spark, tmp_path, physical_plan):
    raw = spark.createDataFrame(
        [(i, f"review number {i}", float(i % 7), "A", "U") for i in range(200)],
        "id bigint, text string, rating double, asin string, user_id string",
    )
    raw.write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    sample = ingest(raw, "id", {1.0: 1.0, 2.0: 0.5})
    plan = physical_plan(sample)
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan
    assert "PushedFilters: [IsNotNull(text)" in plan
    ratings = [r.rating for r in sample.collect()]
    assert ratings.count(1.0) == 29 and 0 < ratings.count(2.0) < 29 and set(ratings) == {1.0, 2.0}
    funnel = {r.stage: r.kept for r in ingest_funnel(raw, "id").collect()}
    assert funnel["raw"] == 200 and funnel["label_in_domain"] == sum(1 <= i % 7 <= 5 for i in range(200))


def test_funnel_counts_null_predicates_as_dropped(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "long enough text", None), (3, "long enough text", 4.0)], SCHEMA)
    kept = [r.kept for r in filter_funnel(df, structural_stages()).orderBy("step").collect()]
    assert kept == [3, 2, 2, 2, 1, 1]


def test_profile_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert class_distribution(empty).count() == 0
    assert {r.n_missing for r in missing_profile(empty).collect()} == {0}


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, "a", float("nan")), (2, "b", None), (3, "c", 2.0)], SCHEMA)
    assert {r.column: r.n_missing for r in missing_profile(df).collect()}["rating"] == 2
    assert [(r.rating, r.n) for r in class_distribution(df).collect()] == [(2.0, 1)]
