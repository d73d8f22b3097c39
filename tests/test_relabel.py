import json

import pyarrow as pa
import pytest

from labelwright.operators import relabel
from labelwright.operators.relabel import INSTRUCTION, _check_usable
from labelwright.plans.curation import ask_model, curate
from labelwright.session import scratch_path
from labelwright.sources.answers import read_answers

RECORD = '{"row_id":"1","text":"t","rating":4,"corrected":true,"reason":"r"}'

SHAPES = [
    (f"[{RECORD}]", 1),
    (f"  [{RECORD},{RECORD}]\n", 2),
    (f"Sure: [{RECORD}] that is all", 1),
    ('{"reviews": [%s, %s]}' % (RECORD, RECORD), 2),
    ('{"note": "x", "items": [%s]}' % RECORD, 1),
    ('{"note":"[hint] used","reviews":[%s]}' % RECORD, 1),
    (RECORD, 1),
    ('{"text":"a [fine] record","rating":5}', 1),
    ("[]", 0),
    ('["a", 3, %s]' % RECORD, 3),
    ('[{"rating": NaN, "text": "t"}]', 1),
    ("[1] and [2]", None),
    (f"[{RECORD}] trailing", None),
    ('{"ok": true}', None),
    ("no json at all", None),
    ("", None),
    ("[{broken]", None),
]


@pytest.mark.parametrize(("raw", "n"), SHAPES)
def test_response_items(spark, raw, n):
    log = spark.createDataFrame([(1, ["1"], raw, 1, None)], relabel.LOG_SCHEMA)
    items = relabel.parse_responses(log).first()["items"]
    assert (None if items is None else len(items)) == n


@pytest.mark.parametrize(("raw", "n"), SHAPES)
def test_retry_check_agrees_with_the_parser(raw, n):
    if n is None:
        with pytest.raises(Exception):
            _check_usable(raw)
    else:
        _check_usable(raw)


def records_of(spark, items):
    log = spark.createDataFrame(
        [(1, ["1"], json.dumps(items), 1, None)], relabel.LOG_SCHEMA
    )
    return relabel.sanitize_records(relabel.parse_responses(log)).orderBy("pos").collect()


@pytest.mark.parametrize(
    ("rating", "outcome", "value"),
    [
        (4, "ok", 4.0),
        ("4", "ok", 4.0),
        (" 3 ", "ok", 3.0),
        (2.5, "normalized", 2.0),
        (5.5, "invalid", None),
        (0.5, "invalid", None),
        (9, "invalid", None),
        (True, "invalid", None),
        (None, "invalid", None),
        ("many", "invalid", None),
        (float("nan"), "invalid", None),
        (float("inf"), "invalid", None),
        ([4], "invalid", None),
    ],
)
def test_sanitize_rating(spark, rating, outcome, value):
    (got,) = records_of(spark, [{"row_id": "1", "text": "t", "rating": rating}])
    assert (got.outcome, got.rating) == (outcome, value)


def test_sanitize_keys_and_types(spark):
    got = records_of(spark, [{"text": "t"}, {"rating": 3}, "text", 7, None, [1]])
    assert [r.outcome for r in got] == ["missing_key"] * 6


@pytest.mark.parametrize(("flag", "expected"), [(True, True), (False, False), ("true", True), ("maybe", False), (None, False)])
def test_corrected_flag(spark, flag, expected):
    (got,) = records_of(spark, [{"row_id": "1", "text": "t", "rating": 3, "corrected": flag}])
    assert got.corrected is expected


@pytest.fixture
def flagged(spark):
    data = [(i, f"text {i} " + "x" * 600, float(i % 5 + 1), float(i % 3 + 1)) for i in range(23)]
    return spark.createDataFrame(data, "id bigint, text string, rating double, suggested_rating double")


def answering(change=lambda records, prompt: records):
    def complete(prompt):
        items = json.loads(prompt[len(INSTRUCTION):])
        records = [
            {"row_id": i["row_id"], "text": i["text"], "rating": i["suggested_rating"],
             "corrected": i["rating"] != i["suggested_rating"], "reason": "hint"}
            for i in items
        ]
        return json.dumps(change(records, prompt))

    return complete


def test_requests_hold_whole_texts_unless_told(flagged):
    requests = relabel.build_requests(flagged, "id").collect()
    sizes = sorted(len(r["items"]) for r in requests)
    assert sizes == [3, 5, 5, 5, 5]
    whole = {str(r.id): r.text for r in flagged.collect()}
    assert {i.row_id: i.text for r in requests for i in r["items"]} == whole
    cut = relabel.build_requests(flagged, "id", max_chars=500).collect()
    assert {len(i.text) for r in cut for i in r["items"]} == {500}


def test_rows_that_no_request_covers_come_back(spark, flagged):
    log = ask_model(flagged.filter("id < 7"), answering(), scratch_path(spark, "log"), "id", wait_seconds=0.0)
    result = curate(flagged, flagged.limit(0), log, "id")
    rows = result.corrected.collect()
    assert sorted(r.id for r in rows) == sorted(r.id for r in flagged.collect())
    assert {r.reason for r in rows if r.id >= 7} == {"not_asked"}
    counters = {r.counter: r.value for r in result.counters.collect()}
    assert counters["rows_not_asked"] == flagged.count() - 7


def test_every_row_comes_back_once_with_its_whole_text(spark, flagged):
    """Answers out of order, one missing, one twice, one about a foreign row."""
    def disorder(records, _):
        return [*reversed(records[1:]), records[1], {**records[1], "row_id": "999"}]

    log = ask_model(flagged, answering(disorder), scratch_path(spark, "log"), "id", wait_seconds=0.0)
    result = curate(flagged, flagged.limit(0), log, "id")
    rows = {r.id: r for r in result.corrected.collect()}
    assert len(rows) == 23 == result.corrected.count()
    original = {r.id: r for r in flagged.collect()}
    assert all(rows[i].text == original[i].text for i in original)
    kept = [r for r in rows.values() if r.source == "original_noisy"]
    assert len(kept) == 5 and {r.reason for r in kept} == {"llm_partial_batch_fallback"}
    assert all(r.rating == original[r.id].rating for r in kept)
    counters = {r.counter: r.value for r in result.counters.collect()}
    assert counters["calls"] == 5 and counters["rows_original_noisy"] == 5


def test_retries_and_failures(spark, flagged):
    def fails(prompt):
        raise TimeoutError("too slow")

    log = ask_model(flagged, fails, scratch_path(spark, "log"), "id", wait_seconds=0.0)
    rows = log.collect()
    assert {r.attempts for r in rows} == {3}
    assert {r.error for r in rows} == {"TimeoutError: too slow"}
    result = curate(flagged, flagged.limit(0), log, "id")
    assert {(r.source, r.reason) for r in result.corrected.collect()} == {("original_noisy", "llm_error_fallback")}
    assert result.reasons.count() == 5
    counters = {r.counter: r.value for r in result.counters.collect()}
    assert counters["failure_pct"] == 100.0


def test_empty_answer_counts_as_success_but_falls_back(spark, flagged):
    log = ask_model(flagged, lambda prompt: "[]", scratch_path(spark, "log"), "id", wait_seconds=0.0)
    result = curate(flagged, flagged.limit(0), log, "id")
    assert {r.reason for r in result.corrected.collect()} == {"llm_error_fallback"}
    assert {r.counter: r.value for r in result.counters.collect()}["failures"] == 0


def test_resume_asks_only_for_the_rest(spark, flagged):
    path = scratch_path(spark, "log")
    ask_model(flagged.filter("id < 7"), answering(), path, "id", wait_seconds=0.0)
    log = ask_model(flagged, answering(), path, "id", wait_seconds=0.0, batches_per_commit=2)
    asked = [i for r in log.collect() for i in r.row_ids]
    assert sorted(map(int, asked)) == list(range(23))
    result = curate(flagged, flagged.limit(0), log, "id")
    assert result.corrected.count() == 23
    before = log.count()
    assert ask_model(flagged, answering(), path, "id", wait_seconds=0.0).count() == before


def counting(folder, stop_at=None):
    """Answers, leaves a file for each call, and ends its Python worker on call ``stop_at``."""
    reply = answering()

    def complete(prompt):
        import os
        import uuid

        (folder / uuid.uuid4().hex).touch()
        if stop_at is not None and len(list(folder.iterdir())) == stop_at:
            os._exit(1)
        return reply(prompt)

    return complete


def test_a_lost_task_asks_only_for_the_rest(spark, flagged, tmp_path):
    path = scratch_path(spark, "log")
    with pytest.raises(Exception, match="(?i)worker|crash|exit"):
        ask_model(flagged, counting(tmp_path, 4), path, "id", wait_seconds=0.0, callers=1)
    assert len(list(tmp_path.iterdir())) == 4 and read_answers(spark, path).count() == 0
    log = ask_model(flagged, counting(tmp_path), path, "id", wait_seconds=0.0, callers=1)
    # Five requests; only the one that was lost with its worker was made twice.
    assert len(list(tmp_path.iterdir())) == 6
    assert sorted(int(i) for r in log.collect() for i in r.row_ids) == list(range(23))
    result = curate(flagged, flagged.limit(0), log, "id")
    assert result.corrected.count() == 23
    counters = {r.counter: r.value for r in result.counters.collect()}
    assert counters["calls"] == 5 and counters["failures"] == 0


def test_a_second_attempt_reads_the_journal(spark, flagged, tmp_path):
    prompts = relabel.build_prompt(relabel.build_requests(flagged, "id"))
    journal = scratch_path(spark, "journal")
    first, second = (
        sorted(relabel.complete_batches(prompts, counting(tmp_path), wait_seconds=0.0, journal=journal).collect())
        for _ in range(2)
    )
    assert first == second and len(first) == 5 == len(list(tmp_path.iterdir()))


def test_a_journal_that_the_log_has_already_adds_nothing(spark, flagged, tmp_path):
    """A stop after the commit and before the journal is removed."""
    path = scratch_path(spark, "log")
    ask_model(flagged, answering(), path, "id", wait_seconds=0.0)
    prompts = relabel.build_prompt(relabel.build_requests(flagged, "id"))
    relabel.complete_batches(prompts, answering(), wait_seconds=0.0, journal=f"{path}-journal").collect()
    log = ask_model(flagged, counting(tmp_path), path, "id", wait_seconds=0.0)
    assert not list(tmp_path.iterdir())
    assert sorted(int(i) for r in log.collect() for i in r.row_ids) == list(range(23))


def test_no_log_yet(spark):
    assert read_answers(spark, scratch_path(spark, "absent")).count() == 0


def test_speculation_is_refused(spark, flagged, monkeypatch):
    prompts = relabel.build_prompt(relabel.build_requests(flagged, "id"))
    settings = spark.sparkContext.getConf().set("spark.speculation", "true")
    monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda self: settings)
    with pytest.raises(ValueError, match="speculation"):
        relabel.complete_batches(prompts, str)


def test_curated_rows_are_valid(spark):
    schema = "id bigint, text string, rating double, source string"
    clean = spark.createDataFrame([(1, "a", 3.0, ""), (2, None, 3.0, ""), (3, "c", 2.5, "")], schema)
    fixed = spark.createDataFrame([(4, "d", 5.0, "verified"), (5, "e", float("nan"), "corrected")], schema)
    got = relabel.assemble_curated(clean, fixed, "id").collect()
    assert sorted((r.id, r.source) for r in got) == [(1, "clean_original"), (4, "verified")]


def test_answers_are_passed_on_by_slices():
    """One Arrow batch of many requests: the first answers leave before the later requests are asked."""
    n = 3 * relabel.SLICE_REQUESTS + 1
    batch = pa.RecordBatch.from_pylist(
        [{"batch_id": i, "row_ids": [str(i)], "prompt": f"p{i}"} for i in range(n)]
    )
    asked = []
    answers = relabel._answers(iter([batch]), lambda prompt: asked.append(prompt) or "[]", 1, 0.0, None)
    first = next(answers)
    assert first.num_rows == len(asked) == relabel.SLICE_REQUESTS
    rows = first.to_pylist() + [row for later in answers for row in later.to_pylist()]
    assert [(r["batch_id"], r["row_ids"], r["raw"], r["error"]) for r in rows] == [
        (i, [str(i)], "[]", None) for i in range(n)
    ]
