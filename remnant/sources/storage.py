"""Shared working storage: checkpoints and derived files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir.

    Where it is unset, a session within one process makes a temporary folder; a cluster must
    name one, since executors do not see each other's disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="remnant-")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, so that no earlier output is ever overwritten."""
    return f"{shared_dir(spark).rstrip('/')}/remnant-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: several passes read the stored rows instead of the whole plan."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table into the shared folder and read it back; also its folder.

    Unlike a checkpoint, the table that is read has the size of its files as statistics, and not
    the product of the sizes of all that was joined to make it.  Loops and small tables need that.
    """
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that `stored` made, once nothing reads it any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
