"""Web archives (WARC 1.1) as a Spark data source, for reading and writing.

Every record is a gzip member of its own that states its length in the header field
``sl`` (the skip length of the format's annex on compression). A reader decodes the
record's headers only, tests the pushed predicates on them, and jumps to the next
member when the record is not wanted; payloads are decoded only for wanted records
and only if the payload is a column of the schema read.

Writing: an attempt writes files of its own, cut at ``FILE_BYTES``; the files of the
attempts that Spark commits are listed in a manifest, and readers read what manifests
list. Files of lost attempts are never read. Reading: files are planned into
partitions of about ``PARTITION_BYTES``. Paths may be local or anything that Arrow's
file systems open.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the
smallest page id holds the payload; the others are revisit records, which keep the
HTTP headers, so the payload's length and digest are known without it.

Defined results: a null html is an empty payload; rows that repeat the smallest page id
are all responses; a null page id never is the smallest, unless all are null, when all
are responses; a null url is left out and read as null; line breaks in a url are
escaped; an empty table makes an empty archive. Extra columns of pages are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In,
    InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from labelwright.session import scratch_path, spool

MIN_REVISIT = 100
FILE_BYTES = 64 << 20
PARTITION_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)
HEADER_COLUMNS = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: gzip: magic, deflate, flag for an extra field, no time, fastest, unknown system;
#: the field is 12 bytes: "sl", 8, packed and unpacked length.
_GZIP = "<4sIBBH2sHII"
_GZIP_SIZE = struct.calcsize(_GZIP)
_HEAD = b"\x1f\x8b\x08\x04"


def open_folder(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = _GZIP_SIZE + len(body) + 8
    if size > 0xFFFFFFFF or len(record) > 0xFFFFFFFF:
        raise ValueError("a record is larger than a gzip member may be")
    head = struct.pack(_GZIP, _HEAD, 0, 4, 255, 12, b"sl", 8, size, len(record))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record))


def record_bytes(
    page_id: int | None, url: str | None, record_type: str, refers_to: int | None,
    digest: str, payload: bytes,
) -> bytes:
    """An unpacked record."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if record_type == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        escaped = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"WARC-Target-URI: {escaped}")
    # The tables hold no time of capture; the format wants one.
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if record_type == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, object]:
    """The header columns, from the record's and the HTTP headers (both end in a blank line)."""
    record, _, http = head.partition(b"\r\n\r\n")
    fields = {}
    for line in record.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode()
    length = None
    for line in http.split(b"\r\n"):
        if line.lower().startswith(b"content-length:"):
            length = int(line.split(b":")[1])
            break
    number = lambda x: int(x) if (x := x.strip("<>").rpartition(":")[2]) else None
    url = fields.get(b"warc-target-uri")
    if url is not None:
        url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    return {
        "page_id": number(fields[b"warc-record-id"]),
        "url": url,
        "record_type": fields[b"warc-type"],
        "refers_to": number(fields.get(b"warc-refers-to", "")),
        "payload_bytes": length,
        "payload_digest": fields[b"warc-payload-digest"].rpartition(":")[2],
    }


def read_records(file, wanted, with_payload: bool) -> Iterator[dict[str, object]]:
    """The records of an open file whose header columns pass ``wanted``."""
    at, end = 0, file.size()
    while at < end:
        file.seek(at)
        magic, _, _, _, extra, mark, _, size, length = struct.unpack(_GZIP, file.read(_GZIP_SIZE))
        if magic != _HEAD or extra != 12 or mark != b"sl":
            raise ValueError(f"no record with a skip length at byte {at}")
        at += size
        unpack = zlib.decompressobj(-15)
        packed = file.read(min(2048, size - _GZIP_SIZE))
        head = unpack.decompress(packed, 1024)
        while head.count(b"\r\n\r\n") < 2 and len(head) < length:
            if not unpack.unconsumed_tail:
                packed = file.read(min(2048, at - file.tell()))
                if not packed:
                    break
            head += unpack.decompress(unpack.unconsumed_tail or packed, 4096)
        cut = head.find(b"\r\n\r\n", head.find(b"\r\n\r\n") + 4) + 4
        row = parse_headers(head[:cut])
        if not wanted(row):
            continue
        if with_payload:
            if row["record_type"] == "revisit":
                row["payload"] = None
            else:
                whole = head + unpack.decompress(unpack.unconsumed_tail + file.read(at - file.tell()))
                row["payload"] = whole[cut : cut + row["payload_bytes"]]
        yield row


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.names = schema.fieldNames()
        self.arrow = pa.schema([(f.name, _ARROW[f.name]) for f in schema.fields])
        self.path = path
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for test in filters:
            name = ".".join(getattr(test, "attribute", ()))
            if name in HEADER_COLUMNS and type(test) in (EqualTo, EqualNullSafe):
                self.tests.append(("is", name, test.value))
            elif name in HEADER_COLUMNS and type(test) is In:
                self.tests.append(("in", name, frozenset(test.value)))
            else:
                yield test

    def wanted(self, row: dict) -> bool:
        for kind, name, value in self.tests:
            if (row[name] != value) if kind == "is" else (row[name] not in value):
                return False
        return True

    def partitions(self):
        folder, base = open_folder(self.path)
        files = set()
        for info in folder.get_file_info(arrow_fs.FileSelector(base)):
            if info.base_name.startswith("_manifest-"):
                with folder.open_input_stream(info.path) as lines:
                    files.update((name, size) for name, size in json.loads(lines.read()))
        plan, names, held = [], [], 0
        for name, size in sorted(files):
            if names and held + size > PARTITION_BYTES:
                plan.append(Files(names))
                names, held = [], 0
            names.append(name)
            held += size
        return [*plan, Files(names)]

    def read(self, partition):
        folder, base = open_folder(self.path)
        rows, held = [], 0
        for name in partition.names:
            with folder.open_input_file(f"{base}/{name}") as file:
                for row in read_records(file, self.wanted, "payload" in self.names):
                    rows.append(row)
                    held += 500 + len(row.get("payload") or b"")
                    if held > BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {n: [r[n] for r in rows] for n in self.names}, schema=self.arrow
        )


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        folder, base = open_folder(self.path)
        folder.create_dir(base, recursive=True)
        files: list[tuple[str, int]] = []
        out, name, size = None, "", 0
        try:
            for batch in iterator:
                columns = [batch.column(n) for n in (*HEADER_COLUMNS, "payload")]
                for i in range(batch.num_rows):
                    page, url, kind, refers, _, digest, payload = (c[i].as_py() for c in columns)
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = folder.open_output_stream(f"{base}/{name}", compression=None)
                    member = _member(record_bytes(page, url, kind, refers, digest, payload or b""))
                    out.write(member)
                    size += len(member)
                    if size >= FILE_BYTES:
                        out.close()
                        files.append((name, size))
                        out = None
            if out is not None:
                out.close()
                files.append((name, size))
                out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        folder, base = open_folder(self.path)
        folder.create_dir(base, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with folder.open_output_stream(f"{base}/_manifest-{uuid.uuid4().hex}", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        """Nothing lists the files, so nobody reads them."""


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options["path"])

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are only added to; write to a new folder")
        return WarcWriter(self.options["path"])


_ARROW = {
    "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
    "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(),
}


def register(spark: SparkSession) -> None:
    """Make the format known, and let predicates reach it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """One row per page with the columns of SCHEMA.

    Only digests that occur more than once are joined back. They are written first, so
    Spark knows their size: a small table is broadcast, a large one is joined by digest,
    where AQE splits a digest that many pages share.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    digested = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html.cast("binary"), 256).alias("payload_digest"),
        html.cast("binary").alias("payload"),
    )
    shared = spool(
        digested.where(F.col("payload_bytes") >= min_revisit)
        .groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL").drop("n"),
        "revisits",
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return digested.join(shared, "payload_digest", "left").select(
        "page_id", "url",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
        "payload_bytes", "payload_digest", "payload",
    )


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    register(pages.sparkSession)
    with_records(pages, min_revisit).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """Records of an archive. ``columns``: those of SCHEMA to read; without ``payload`` none is decoded."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to an archive in the shared folder and read back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
