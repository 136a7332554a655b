"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a bucket, on average, and rows of a small table that are sent to all tasks rather than joined by a shuffle.
ROWS_OF_A_BUCKET, BROADCAST_ROWS = 2_000_000, 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """Make checkpoint() usable and name its folder: the cluster's ``spark.checkpoint.dir``.

    Only on a local master, as in tests, a temporary folder stands in for an unset one; elsewhere that would
    put files where other machines can't read them, so it is an error.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(configured or os.path.join(tempfile.gettempdir(), "citeloom-checkpoints"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and go on from those files, which outlive executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder: like :func:`cut`, but later readers take only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.written_to = path
    return out


def bucketed(df: DataFrame, by: str, rows: int) -> DataFrame:
    """``df`` as a table in the shared folder, dealt by a column once: joins with broadcast tables and groups by that column send none of its rows."""
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_OF_A_BUCKET + 1)
    path = f"{shared_folder(spark)}/table-{name}"
    df.repartition(parts, by).write.bucketBy(parts, by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.written_to, out.named = path, name
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read any more."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def discard(table: DataFrame | None) -> None:
    """Delete a table made by :func:`written` or :func:`bucketed`; others are left alone."""
    path = getattr(table, "written_to", None)
    if hasattr(table, "named"):
        table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.named}")
    if path is not None:
        remove(table.sparkSession, path)
