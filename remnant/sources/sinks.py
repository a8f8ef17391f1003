"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Header, fixed field order, other columns ignored, NULL as an empty field."""
    columns = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields]
    df.select(*columns).write.mode("errorifexists").option("header", "true").option(
        "nullValue", ""
    ).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines into a folder that must not exist yet; readable only once committed."""
    df.write.mode("errorifexists").json(path)
