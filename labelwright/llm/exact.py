"""Exact duplicates by a streaming query with keyed state on disk.

The documents arrive as a file stream. Its state, one row per digest in RocksDB and
without expiry, retains the digest, the number of copies, and the copy that stays: its
identifier and the locator of its content (file and row). Copies combine in each task
before they are dealt out by digest, so a text that fills a third of the table sends one
row per task and micro-batch. The state lives in the stream's checkpoint in the shared
folder: later arrivals meet it again, and a lost executor restores it from there.

A digest that was seen before is a hit, not yet a copy: the whole normalised text of
every hit is compared with the one its locator leads to. Should two texts share a digest,
the rows of that digest are grouped by their texts instead. Only texts of digests with
several rows are sent to that comparison; a hot digest meets one row there, so AQE can
split it.

Defined results: a null text is empty, and empty texts are copies of each other; of
equal texts the row with the most code points stays, then the smallest id (null last),
then the first file and row, so that exactly one of repeated rows stays; keep_id is null
where that row's id is null; an empty table gives no rows; extra columns are left out,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelwright.llm.common import likely_in
from labelwright.session import scratch_path, spool

#: The characters that equality leaves out.
IGNORED = " \t\n\x0b\x0c\r"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else each store sets 4 MB aside for a file of a few hundred bytes.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # One bound for all stores of an executor, however many partitions it holds.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Bytes of files that one micro-batch takes at most (a file is never divided).
BATCH_BYTES = 256 << 30

Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _disk_state(spark: SparkSession):
    """Queries started inside keep their state on disk; the session's settings are restored."""
    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    try:
        for name, value in STATE_SETTINGS.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _any_of(path: str) -> str:
    """A pattern that only ``path`` matches: a stream then takes one file as well as a folder."""
    return f"{path[:-1]}[{path[-1]}]"


def _located(docs: DataFrame, id_col: str, text_col: str, digest: Digest) -> DataFrame:
    """(id, text without ignored characters, n_points, file, row, digest)."""
    place = docs.metadataColumn("_metadata")
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(
        docs[id_col].alias("id"),
        F.translate(text, IGNORED, "").alias("text"),
        F.length(text).alias("n_points"),
        place["file_path"].alias("file"),
        place["row_index"].alias("row"),
    ).withColumn("digest", digest(F.col("text")))


def absorb(
    spark: SparkSession, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text",
    digest: Digest = sha256, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Take the files under ``path`` that ``checkpoint`` has not seen; the state after them.

    (digest, n, keep): keep is the row that stays, as (shorter, no_id, id, file, row).
    """
    schema = spark.read.parquet(path).schema
    arrivals = (
        spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(_any_of(path))
    )
    kept_first = F.struct(
        (-F.col("n_points")).alias("shorter"), F.col("id").isNull().alias("no_id"), "id", "file", "row"
    )
    seen = (
        _located(arrivals, id_col, text_col, digest)
        .groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(kept_first).alias("keep"))
    )
    with _disk_state(spark):
        running = (
            seen.writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    running.awaitTermination()
    if running.lastProgress is None and not _has_state(spark, checkpoint):
        kept = spark.read.parquet(path)
        return _located(kept, id_col, text_col, digest).limit(0).groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"), F.min(kept_first).alias("keep")
        )
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(
        F.col("key").getField(state.schema["key"].dataType.names[0]).alias("digest"),
        F.col("value").getField(state.schema["value"].dataType.names[0]).alias("n"),
        F.col("value").getField(state.schema["value"].dataType.names[1]).alias("keep"),
    )


def _has_state(spark: SparkSession, checkpoint: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state/0/0")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _false_hits(docs: DataFrame, text_col: str, members: DataFrame) -> DataFrame:
    """Digests under which a row's text differs from the text that stays, byte by byte.

    ``members``: the rows (file, row, digest, stays) of digests with several rows. Their
    texts are fetched by locator.
    """
    place = docs.metadataColumn("_metadata")
    texts = docs.select(
        docs[text_col].alias("text"), place["file_path"].alias("file"), place["row_index"].alias("row")
    )
    key = F.xxhash64("file", "row")
    held = (
        likely_in(texts, key, members, key).join(members, ["file", "row"])
        .select("digest", "stays", F.translate(F.coalesce("text", F.lit("")), IGNORED, "").alias("text"))
    )
    staying = held.where("stays").select("digest", F.col("text").alias("kept_text"))
    hits = held.where("NOT stays").select("digest", "text")
    # Not made distinct here: a grouping by digest would keep AQE from dividing a hot one.
    return hits.join(staying, "digest").where("text <> kept_text").select("digest")


def _by_text(rows: DataFrame) -> DataFrame:
    """The result's rows for documents of digests that several texts share."""
    order = F.struct((-F.col("n_points")).alias("shorter"), F.col("id").isNull().alias("no_id"), "id", "file", "row")
    groups = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("keep"))
    return rows.join(groups, "text").withColumn(
        "stays", (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    )


def deduplicate(
    spark: SparkSession, path: str, checkpoint: str | None = None, id_col: str = "doc_id",
    text_col: str = "text", digest: Digest = sha256, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row per document under ``path``: id, keep_id, group_size, kept, digest, file, row.

    ``checkpoint``: the stream's folder, where a later call goes on; a new one if not given.
    With it, files that were added meanwhile are the only ones to pass through the stream.
    """
    place = checkpoint or scratch_path(spark, "exact")
    state = spool(absorb(spark, path, place, id_col, text_col, digest, batch_bytes), "exact-state")
    docs = spark.read.parquet(path)
    located = _located(docs, id_col, text_col, digest)
    judged = spool(
        spool(located.select("id", "file", "row", "digest"), "located").join(state, "digest").withColumn(
            "stays", (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
        ),
        "judged",
    )
    members = judged.where("n > 1").select("file", "row", "digest", "stays")
    false = spool(_false_hits(docs, text_col, members), "false-hits")
    if not false.isEmpty():
        judged = judged.join(false, "digest", "left_anti").unionByName(
            _by_text(located.join(false, "digest", "left_semi")).select(*judged.columns)
        )
    return judged.select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("stays").alias("kept"),
        "digest",
        "file",
        "row",
    )
