"""Indexes of files by the id in their name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_ID = r"(?i)(\d{6,12})\.jpg$"


def list_files(spark: SparkSession, roots: list[str], glob: str = "*") -> DataFrame:
    """Paths under the roots; only the path column is read, never the content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(roots)
        .select("path")
    )


def directory_priority(path: Column, directories: list[str]) -> Column:
    """Place of the path's directory in the list of preferred directories."""
    out = F.lit(len(directories))
    for i in reversed(range(len(directories))):
        out = F.when(F.contains(path, F.lit(f"/{directories[i]}/")), F.lit(i)).otherwise(out)
    return out


def index_files(paths: DataFrame, id_regex: str = IMAGE_ID, priority: Column | None = None) -> DataFrame:
    """file_id and path: the path of best priority per id, then the smallest path."""
    ids = paths.select(
        F.regexp_extract("path", id_regex, 1).try_cast("bigint").alias("file_id"),
        (priority if priority is not None else F.lit(0)).alias("priority"),
        "path",
    ).filter(F.col("file_id").isNotNull())
    return ids.groupBy("file_id").agg(F.min_by("path", F.struct("priority", "path")).alias("path"))
