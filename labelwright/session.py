"""Session set-up and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "labelwright", cores: str = "8", memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A local session without one gets a temporary folder. A cluster session
    without one is an error: executors could not see a folder of the driver.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="labelwright-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of this library's own, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Tables of wide rows, written: bytes of a row group, and rows between two looks at its size and at a page's.
#: Parquet looks after 100 rows by default, holds a row group in memory until it is full, and compresses a page
#: through buffers of its size outside the heap, which stay. A reader holds the same.
WIDE_ROWS = {
    "parquet.block.size": str(8 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
}


def spool(df: DataFrame, name: str = "spool", wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, keeps column pruning and filter pushdown for later readers,
    and survives the loss of any executor. ``wide``: rows of up to some MB each.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**(WIDE_ROWS if wide else {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.spooled_at = path
    return out


def release(*spooled: DataFrame) -> None:
    """Remove what ``spool`` wrote for these tables. Nothing made from them may be read after it, but what was spooled."""
    for df in spooled:
        discard(df.sparkSession, df.spooled_at)
