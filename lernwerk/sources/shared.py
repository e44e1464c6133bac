"""The folder that driver and executors share, for tables between jobs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the checkpoint folder set on its context.

    Where neither is set and everything runs on this machine (tests), a temporary folder is made; on
    a cluster that is an error, since executors don't see each other's local files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        folder = tempfile.mkdtemp(prefix="lernwerk-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet; it is removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/lernwerk-{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def materialise(df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path, compression=codec)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    rows._lernwerk_path = path
    return rows


def release(rows: DataFrame) -> None:
    """Delete a table that ``materialise`` has written and nothing reads any more."""
    remove(rows.sparkSession, rows._lernwerk_path)
