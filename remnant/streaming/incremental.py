"""Incremental work: what is still to be done, and writing results so that reruns are safe.

The computations have no event time, windows or state; the only incremental behaviour is
resuming a partly finished set of runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_runs(
    requested: DataFrame, done: DataFrame, keys: list[str], expected: str | None = None, rows: str = "n",
) -> DataFrame:
    """Requested runs without a finished result of the same keys (run, scorer version, ...).

    With `expected`, a column of the requested runs, a result is finished only if its number of
    rows equals it.
    """
    if expected is None:
        return requested.join(done.select(*keys), keys, "left_anti")
    finished = done.select(*keys, F.col(rows).alias("_rows")).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.col(expected) == F.col("_rows")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return requested.join(finished, same, "left_anti")


def write_run(df: DataFrame, path: str, run_column: str = "run", fmt: str = "json") -> None:
    """Append finished runs under one directory per run.

    Files become visible only when the job commits, and existing results are not touched,
    so an interrupted write leaves the earlier runs as they were.
    """
    df.write.mode("append").partitionBy(run_column).format(fmt).save(path)


def completed_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()
