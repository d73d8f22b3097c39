import random
import re
import sys
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from labelwright.llm import bpe, stages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string"


def documents():
    rng = random.Random(6)
    parts = ["the", "er", "an", "on", "ing", "ed", "st", "nd", "re", "ly"]
    rows = []
    for i in range(160):
        words = ["".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(30, 60))]
        if i % 4 == 0:
            words[5] = words[20] = rng.choice(["idiot", "moron", "scum"])
        if i % 5 == 1:
            words[3] = "password=hunter2hunter"
        rows.append([i, " ".join(words)])
    rows[11][1] = rows[7][1]
    rows[14][1] = rows[9][1] + " more words"
    rows += [[200, None], [201, ""], [202, ""], [None, "only here and there without any id"],
             [None, "only here and there without any id"], [rows[3][0], rows[3][1]]]
    return [(d, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), "x") for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 4 == 0)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_toxic_documents_go(spark, docs, folder):
    kept = stages.not_toxic(spark, docs, folder)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not [i for i in ids if i is not None and i < 160 and i % 4 == 0]
    assert len([i for i in ids if i is not None and i < 160]) >= 115


def test_one_of_each_group_stays(spark, docs, folder):
    kept = stages.one_of_each(spark, docs, folder)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    want = [i for i in range(160) if i not in (11, 14)] + [200, 201, 202]
    assert ids == sorted([(False, i) for i in want] + [(True, 0)])


def test_secrets_are_masked(spark, docs, folder):
    kept = stages.without_secrets(spark, docs, folder).collect()
    assert len(kept) == docs.count()
    assert not [r for r in kept if r.text and "hunter2" in r.text]
    assert all(r.n_chars == len(r.text) for r in kept if r.text is not None)
    clean = {r.doc_id: r.text for r in docs.collect() if r.text and "password" not in r.text}
    assert all(r.text == clean[r.doc_id] for r in kept if r.doc_id in clean)


def test_mix_takes_the_budget(spark, docs, folder):
    from labelwright.llm import mixing

    plan = mixing.mix(docs).collect()
    got = stages.mixed(spark, docs, folder)
    assert got.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in got.collect()) == sum(r.taken for r in plan)


def test_ids_decode_to_the_text(spark, docs, folder):
    ranks = bpe.load_ranks(public_tokenizers.path(stages.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id IS NOT NULL").collect()}
    for r in stages.tokens(spark, docs, folder).where("doc_id IS NOT NULL").collect():
        assert r.text == texts[r.doc_id] and r.ids == library.encode_ordinary(r.text)
        assert r.n_tokens == len(r.ids) and r._row == "x"


def test_run_equals_the_stages_one_by_one(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "mixing", "bpe"]
    by_hand = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        by_hand = stage(spark, by_hand, folder)
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, by_hand.collect()))


def test_empty_tables(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == [], name
