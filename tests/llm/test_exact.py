import hashlib
import re

import pytest
from pyspark.sql import functions as F

import labelwright.llm.exact as exact

SCHEMA = "doc_id long, text string, digest string, _metadata string, FILE int"
BLANKS = re.compile(r"[\x20\x09-\x0D]")


def documents():
    out = [(i, f"text  number {i % 50}{' ' * (i % 3)}", "d", "m", 1) for i in range(400)]
    out += [(1000 + i, "the hot\ttext", "d", "m", 1) for i in range(300)]
    out += [(1, "text number 1 ", "d", "m", 1)] * 2 + [(2000, None, "d", "m", 1), (2001, "", "d", "m", 1), (2002, " \n\r", "d", "m", 1)]
    out += [(None, "no id", "d", "m", 1), (None, "no id", "d", "m", 1), (3000, "noid", "d", "m", 1), (None, "lone", "d", "m", 1)]
    out += [(3001, " no space", "d", "m", 1), (3002, "nospace", "d", "m", 1), (3003, "É🙂", "d", "m", 1), (3004, "É 🙂", "d", "m", 1)]
    return out + [(3005, "x y" * 400_000, "d", "m", 1), (3006, "xy " * 400_000, "d", "m", 1)]


def expected(rows):
    groups = {}
    for doc, text, *_ in rows:
        text = text or ""
        groups.setdefault(BLANKS.sub("", text), []).append((-len(text), doc is None, doc or 0, doc))
    return {key: (min(held)[3], len(held)) for key, held in groups.items()}


def check(got, rows):
    want = expected(rows)
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(key.encode()).hexdigest(): value for key, value in want.items()}
    kept = {}
    for r in got:
        assert (r.keep_id, r.group_size) == by_digest[r.sha]
        kept[r.sha] = kept.get(r.sha, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len(want)


def collected(df):
    return df.withColumn("sha", F.lower(F.hex("digest"))).collect()


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame(documents(), SCHEMA).repartition(5).write.parquet(path)
    return path


def test_equals_brute_force(spark, folder):
    check(collected(exact.deduplicate(spark, folder)), documents())


def test_one_file_and_small_batches(spark, tmp_path, folder):
    check(collected(exact.deduplicate(spark, folder, batch_bytes=1)), documents())
    import glob
    import shutil

    one = str(tmp_path / "one.parquet")
    shutil.copy(max(glob.glob(f"{folder}/part-*")), one)
    rows = [tuple(r) for r in spark.read.parquet(one).collect()]
    check(collected(exact.deduplicate(spark, one)), rows)


def test_later_arrivals_meet_the_state(spark, folder, tmp_path):
    place = str(tmp_path / "state")
    exact.absorb(spark, folder, place)
    late = [(5000, "thehot text", "d", "m", 1), (5001, "never seen", "d", "m", 1), (5002, "the  hot   text", "d", "m", 1)]
    spark.createDataFrame(late, SCHEMA).write.mode("append").parquet(folder)
    state = exact.absorb(spark, folder, place)
    hot = state.where(F.col("digest") == exact.sha256(F.lit("thehottext"))).first()
    assert (hot.n, hot.keep.id) == (302, 5002)
    assert state.where("keep.id = 5001").first().n == 1
    check(collected(exact.deduplicate(spark, folder, place)), documents() + late)
    # What it took before is not taken again.
    assert exact.absorb(spark, folder, place).agg(F.sum("n")).first()[0] == len(documents()) + 3


def test_texts_of_one_digest_are_told_apart(spark, folder):
    """Full texts decide: with a digest of three values nearly all hits are false."""
    short = lambda text: F.substring(F.sha2(text, 256), 1, 1).cast("binary")
    got = exact.deduplicate(spark, folder, digest=short).collect()
    groups, want = expected(documents()), {}
    for doc, text, *_ in documents():
        want.setdefault(doc, set()).add(groups[BLANKS.sub("", text or "")])
    assert len(got) == len(documents()) and sum(r.kept for r in got) == len(groups)
    assert all((r.keep_id, r.group_size) in want[r.doc_id] for r in got)


def test_state_is_on_disk_and_settings_are_restored(spark, folder, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    exact.absorb(spark, folder, str(tmp_path / "state"))
    assert spark.conf.get(name) == before
    assert list((tmp_path / "state" / "state").glob("0/*/*.zip")) or list((tmp_path / "state" / "state").glob("0/*/*.changelog"))


def test_copies_combine_before_they_are_dealt_out(spark, folder):
    plan = exact._located(spark.read.parquet(folder), "doc_id", "text", exact.sha256).groupBy("digest").agg(F.count(F.lit(1)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in text


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert exact.deduplicate(spark, path).collect() == []
