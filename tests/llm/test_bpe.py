import base64
import random

import public_tokenizers
import pytest
import tiktoken

from labelwright.llm import bpe
from labelwright.llm.bpe import Encoder, Merges, decode, encode, load_ranks, replay, round_trip

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, Ids string, extra int"


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def texts():
    rng = random.Random(3)
    alphabet = list("abc etnrihs  \n\t'\x0b\x0c\x1c\x1f\x85\xa0 　!?.,0189äßéñçЖ中文🙂٣़́")
    out = [None, "", " ", "\n\n  ", "a" * 3000, "ab" * 700, "aaa aaaa aaaaa", "<|endoftext|>", "I'll we've don't",
           "!" * 999 + " " * 500, "The theatre there then. Zusammengehörigkeitsgefühl"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x1F300, 0x1F700)]))
                    for _ in range(30)) for _ in range(100)]
    return out


def test_equals_the_library_and_decodes(spark, library):
    data = [(i, t, "clash", 7) for i, t in enumerate(texts())]
    df = encode(spark.createDataFrame(data, SCHEMA), PATH, public_tokenizers.PATTERN)
    assert df.columns == ["doc_id", "text", "extra", "ids"]
    rows = decode(df, PATH, id_bytes="id_bytes").collect()
    assert len(rows) == len(data)
    for r in rows:
        want = library.encode_ordinary(r.text or "")
        assert r.ids == want, r.text
        assert bytes(r.decoded) == (r.text or "").encode()
        assert bytes(r.id_bytes) == b"".join(x.to_bytes(4, "little") for x in want)


def test_merges_of_lower_rank_that_come_up_late_go_first():
    # "ab" + "a" ranks below "ab" itself, so it goes before the next "ab".
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b"aba": 2, b"ab": 3, b"abab": 4}
    library = tiktoken.Encoding("t", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abab", "ababab", "abaabab", "aabba", "abababababa"):
        ids, sizes = replay([text.encode()], Merges(ranks))
        assert ids.tolist() == library.encode_ordinary(text)
        assert sizes.tolist() == [len(ids)]


def test_forgetting_changes_nothing(ranks, library):
    encoder = Encoder(ranks, public_tokenizers.PATTERN, memory=5)
    for text in ("one two three four five six", "six five", "one more time and again"):
        ids, upto = encoder.encode([text, None])
        assert ids.tolist() == library.encode_ordinary(text)
        assert upto.tolist() == [0, len(ids), len(ids)]


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert decode(encode(empty, PATH, public_tokenizers.PATTERN), PATH).collect() == []
    row = decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).first()
    assert bytes(row.decoded) == b""


def test_rank_file_is_read_whole(ranks):
    with open(PATH, "rb") as lines:
        assert len(ranks) == sum(1 for _ in lines)
    assert all(bytes([b]) in ranks for b in range(256))
    assert base64.b64encode(b"a")


def test_round_trip_and_slices(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_IDS", 40)
    monkeypatch.setattr(bpe, "SLICE_BYTES", 200)
    long_text = "".join(random.Random(4).choices("abc de\n", k=200_000))
    data = [(i, t, "clash", 7) for i, t in enumerate([*texts(), long_text])]
    df = spark.createDataFrame(data, SCHEMA)
    rows = round_trip(df, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(data)
    given = {d[0]: d[1] for d in data}
    for r in rows:
        assert r.text == (given[r.doc_id] or "") and r.ids == library.encode_ordinary(r.text)
    both = decode(encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert [bytes(r.decoded).decode() for r in both] == [given[r.doc_id] or "" for r in both]
    assert len(both) == len(data)


def test_memory_of_a_task_is_bounded(ranks):
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(400_000)]
    docs = pa.RecordBatch.from_pydict({"text": [" ".join(words[i : i + 200]) for i in range(0, len(words), 200)]})
    encoder = Encoder(ranks, public_tokenizers.PATTERN)
    tracemalloc.start()
    for part in bpe.small_slices(iter([docs]), "text", bpe.SLICE_BYTES):
        bpe._encoded(encoder, part.column("text"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20, peak
