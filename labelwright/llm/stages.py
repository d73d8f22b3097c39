"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns documents.

All but the last return the columns they got, with ``n_chars`` made true where a text
changed. Rows with null texts or ids, repeated rows and empty tables pass through each
stage as its operator defines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelwright.llm import bpe, minhash, mixing, secrets, toxicity
from labelwright.llm.common import FILTER_BUCKETS, free_name, table
from labelwright.session import spool

RANKS = "byte_bpe_multi_50k.tiktoken"


def _documents(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``documents`` as the stage found them, n_chars made true again."""
    return rows.select(
        *[
            F.length("text").cast("long").alias(name) if name == "n_chars" else name
            for name in columns
        ]
    )


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; learned from the labels of documents that are there."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.without_toxic(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id.

    Of rows that repeat id and text one stays; in a group without ids, that with the
    least text hash. Documents without words stay all. Only documents that share a hash
    bucket with a row to drop are joined; the others pass as they are read.
    """
    row_hash = F.xxhash64(F.lit("row"), "text", "doc_id")
    judged = spool(
        minhash.near_duplicates(docs.select("doc_id", row_hash.alias("row"), "text"))
        .where("component IS NOT NULL").select("doc_id", "row", "component", "component_id", "kept"),
        "judged",
    )
    nameless = judged.where("component_id IS NULL").groupBy("component").agg(F.min("row").alias("least"))
    dropped = spool(
        judged.join(nameless, "component", "left")
        .withColumn("stays", F.col("kept") & (F.col("least").isNull() | (F.col("row") == F.col("least"))))
        .groupBy("doc_id", "row").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("rows"))
        .where("NOT stays OR rows > 1").select(F.col("doc_id").alias("_id"), F.col("row").alias("_key"), "stays"),
        "dropped",
    )
    names = {n: free_name(docs.columns, f"_{n}") for n in ("row", "bucket", "hit", "stays")}
    bucket = lambda c: F.pmod(c, F.lit(FILTER_BUCKETS)).cast("int")
    buckets = dropped.select(bucket(F.col("_key")).alias(names["bucket"])).distinct().withColumn(
        names["hit"], F.lit(True)
    )
    marked = docs.withColumn(names["row"], row_hash).withColumn(
        names["bucket"], bucket(F.col(names["row"]))
    ).join(F.broadcast(buckets), names["bucket"], "left")
    untouched = marked.where(F.col(names["hit"]).isNull()).select(*docs.columns)
    decided = dropped.withColumnRenamed("stays", names["stays"])
    met = marked.where(names["hit"]).join(
        decided,
        (F.col(names["row"]) == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")),
        "left",
    )
    alone = met.where(F.col(names["stays"]).isNull()).select(*docs.columns)
    repeated = met.where(names["stays"]).dropDuplicates(["doc_id", names["row"]]).select(*docs.columns)
    return untouched.unionByName(alone).unionByName(repeated)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked."""
    found = free_name(docs.columns, "_spans")
    scanned = secrets.scan(docs, out=found)
    return _documents(
        scanned.withColumn("text", secrets.redacted(F.col("text"), F.col(found))), docs.columns
    )


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents once for each epoch they are taken in."""
    return _documents(mixing.mixed_rows(mixing.mix(docs)), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``ids`` and ``n_tokens`` of each text, and in place of the text what the ids decode to."""
    path = public_tokenizers.path(RANKS)
    coded = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return coded.select(
        *[n for n in docs.columns if n.lower() not in ("text", "ids", "n_tokens")],
        "text",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
    )
