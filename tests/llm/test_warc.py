import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from labelwright.llm import warc

BIG = "<p>ä🙂</p>\r\n\r\n" * 20


def pages():
    return [
        (3, "http://a/3", BIG, "x"), (1, "http://a/1\r\nX: y%0D", BIG, "x"), (2, None, BIG, "x"), (1, "again", BIG, "x"),
        (4, "", None, "x"), (5, "u", "", "x"), (6, "u", "short", "x"), (7, "u", "short", "x"),
        (8, "u", "y" * 100, "x"), (9, "u", "y" * 100, "x"), (10, "u", "z" * 99, "x"), (11, "u", "z" * 99, "x"),
        (None, "n", BIG, "x"), (None, "n", "w" * 200, "x"), (None, "n", "w" * 200, "x"), (12, "big", "q\n" * 400_000, "x"),
    ]


def brute(rows):
    first = {}
    for page, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, url, html, _ in rows:
        data = (html or "").encode()
        held = first.get(data, page) if len(data) >= 100 else page
        revisit = held is not None and held != page
        out.append((page, url, len(data), hashlib.sha256(data).hexdigest(),
                    "revisit" if revisit else "response", held if revisit else None,
                    None if revisit else data))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, record_type string")
    warc.write_archive(df.repartition(3), path)
    return path


def test_round_trip(spark, archive):
    got = warc.read_archive(spark, "file://" + archive).collect()
    rows = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
             None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(map(repr, rows)) == brute(pages())


def test_files_are_plain_archives(archive, tmp_path):
    import glob

    text = b"".join(gzip.open(f).read() for f in glob.glob(archive + "/*.warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == len(pages())
    assert text.count(b"WARC-Type: revisit") == sum("'revisit'" in r for r in brute(pages()))


def test_predicates_are_pushed_and_payloads_skipped(spark, archive, physical_plan):
    warc.register(spark)
    kinds = warc.read_archive(spark, archive).where("record_type = 'revisit'")
    assert {r.record_type for r in kinds.collect()} == {"revisit"}
    some = warc.read_archive(spark, archive, "page_id long, payload_bytes long").where(F.col("page_id").isin(5, 12))
    assert sorted(map(tuple, some.collect())) == [(5, 0), (12, 800_000)]
    reader = warc.WarcReader(spark.read.format("warc").load(archive).schema, archive)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.In(("page_id",), (1, 2))]))
    assert left == [] and reader.wanted({"record_type": "revisit", "page_id": 2})
    assert not reader.wanted({"record_type": "revisit", "page_id": 3})


def test_headers_are_read_without_the_payload(archive):
    folder, base = warc.open_folder(archive)
    seen = []

    class Counting:
        def __init__(self, file):
            self.file = file

        def read(self, n):
            data = self.file.read(n)
            seen.append(len(data))
            return data

        def __getattr__(self, name):
            return getattr(self.file, name)

    total = 0
    for part in warc.WarcReader(_schema(), archive).partitions():
        for name in part.names:
            with folder.open_input_file(f"{base}/{name}") as file:
                total += sum(1 for _ in warc.read_records(Counting(file), lambda r: True, False))
    assert total == len(pages()) and max(seen) <= 2048


def _schema():
    from pyspark.sql.types import LongType, StructField, StructType

    return StructType([StructField("page_id", LongType())])


def test_uncommitted_files_are_not_read(spark, archive):
    with open(archive + "/lost.warc.gz", "wb") as out:
        out.write(b"half a record")
    assert warc.read_archive(spark, archive).count() == len(pages())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).collect() == []
