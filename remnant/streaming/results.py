"""Run results that appear and are replaced as a whole.

Layout below one folder:

    data/attempt=<id>/run=<run>/...   rows of one write; never changed afterwards
    manifests/seq=<n>/...             what write n made valid: run, version, n_rows, attempt

An attempt is visible only through a manifest, and a manifest appears by one rename that fails if
its number is taken.  So readers see a write whole or not at all, a killed write leaves only rows
that nobody reads, a rerun replaces its runs at once, and writers that meet take the next number.
Where both wrote a run, the later number counts.  The file system must rename folders atomically,
as HDFS and local disks do; manifests are small and one per write.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remnant.sources.storage import discard

TRIES = 100  # numbers that other writers may take meanwhile


def publish_runs(
    df: DataFrame, path: str, version: str, run_column: str = "run", runs: DataFrame | None = None,
    fmt: str = "json",
) -> str:
    """Write the rows of finished runs and make them valid together; the number of the manifest.

    Every run of `df` is replaced as a whole.  `runs` names runs that are valid without rows too,
    so that a rerun without result empties its run.  NULL is a run like any other.  If a task
    fails, the attempt is removed and nothing becomes visible.
    """
    spark, attempt = df.sparkSession, f"a{uuid.uuid4().hex}"
    folder, staged = f"{path}/data/attempt={attempt}", f"{path}/manifests/.{attempt}"
    try:
        df.write.mode("errorifexists").partitionBy(run_column).format(fmt).save(folder)
        # Rows are counted as they were written, which a reader can hold against what it finds.
        written = _rows(spark, folder, df.schema, fmt)
        counts = written.groupBy(F.col(run_column).alias("run")).agg(F.count(F.lit(1)).alias("n_rows"))
        if runs is not None:
            named = runs.select(F.col(run_column).alias("run"), F.lit(0).cast("bigint").alias("n_rows"))
            counts = counts.unionByName(named).groupBy("run").agg(F.sum("n_rows").alias("n_rows"))
        counts.select(
            "run", F.lit(version).alias("version"), "n_rows", F.lit(attempt).alias("attempt")
        ).coalesce(1).write.parquet(staged)
        return str(_publish(spark, staged, f"{path}/manifests"))
    except BaseException:
        for f in (staged, folder):
            discard(spark, f)
        raise


def latest_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per valid run: run, version, n_rows, attempt, seq."""
    m = spark.read.parquet(f"{path}/manifests")
    last = F.max_by(F.struct("version", "n_rows", "attempt", F.col("seq").cast("bigint").alias("seq")), "seq")
    return m.groupBy("run").agg(last.alias("m")).select("run", "m.*")


def read_runs(
    spark: SparkSession, path: str, schema: T.StructType, run_column: str = "run", fmt: str = "json"
) -> DataFrame:
    """Rows of the valid runs, in the given schema; attempts that were replaced are pruned as partitions."""
    if not _exists(spark, f"{path}/manifests"):
        return spark.createDataFrame([], schema)
    wide = T.StructType([*schema.fields, T.StructField("_attempt", T.StringType())])
    rows = _rows(spark, f"{path}/data", wide, fmt, ("_attempt", "attempt"))
    valid = latest_runs(spark, path).select(F.col("run").alias("_run"), F.col("attempt").alias("_valid"))
    same = (F.col("_attempt") == F.col("_valid")) & F.col(run_column).eqNullSafe(F.col("_run"))
    return rows.join(valid, same, "left_semi").select(*schema.names)


def incomplete_runs(rows: DataFrame, valid: DataFrame, run_column: str = "run") -> DataFrame:
    """Valid runs whose rows are not all there: run, n_rows, n_found."""
    found = rows.groupBy(F.col(run_column).alias("_run")).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0).cast("bigint"))
    joined = valid.join(found, F.col("run").eqNullSafe(F.col("_run")), "left")
    return joined.select("run", "n_rows", n.alias("n_found")).filter("n_rows <> n_found")


def _rows(spark, folder, schema, fmt, renamed=None) -> DataFrame:
    """Rows below a folder of partitions, if it holds any; `renamed`: a column and its partition name."""
    names = {renamed[0]: renamed[1]} if renamed else {}
    stored = T.StructType([T.StructField(names.get(f.name, f.name), f.dataType) for f in schema.fields])
    if not _exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(stored).format(fmt).load(folder).withColumnsRenamed({v: k for k, v in names.items()})


def _publish(spark: SparkSession, staged: str, manifests: str) -> int:
    """Give the staged manifest the next free number."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    here = hadoop.Path(staged)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = hadoop.FileContext.getFileContext(here.getFileSystem(conf).getUri(), conf)
    rename = getattr(hadoop, "Options$Rename")
    plain = spark.sparkContext._gateway.new_array(rename, 0)
    names = [s.getPath().getName() for s in here.getFileSystem(conf).listStatus(here.getParent())]
    seq = max((int(n.removeprefix("seq=")) for n in names if n.startswith("seq=")), default=0)
    for _ in range(TRIES):
        seq += 1
        try:
            context.rename(here, hadoop.Path(f"{manifests}/seq={seq}"), plain)
            return seq
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
    raise RuntimeError(f"no free manifest number below {manifests} in {TRIES} tries")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
