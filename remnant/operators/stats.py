"""Correlations and trend lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from remnant.functions import kernels
from remnant.operators.ordering import with_average_rank
from remnant.sources.storage import materialize


def _p_value():
    return F.pandas_udf(kernels.correlation_p_series, DoubleType())


def _pairs(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )


def _corr(x: str, y: str) -> Column:
    """Pearson correlation; NULL for constant input, where the built-in divides by zero."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def _constant_sides() -> list[Column]:
    """Whether each side is constant to eight decimals: minimum = maximum."""
    return [
        (F.min(F.round(c, 8)) == F.max(F.round(c, 8))).alias(n)
        for c, n in (("_x", "x_constant"), ("_y", "y_constant"))
    ]


def _status() -> Column:
    return (
        F.when(F.col("n") < 3, "insufficient data")
        .when(F.col("x_constant") | F.col("y_constant"), "constant input")
        .otherwise("ok")
    )


def correlation_guard(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Why a correlation is not computed: fewer than three rows, or constant input."""
    t = _pairs(df, x, y, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *_constant_sides())
    return t.select(*by, "n", _status().alias("status"))


def correlate(
    df: DataFrame, x: str, y: str, by: list[str], p_values: bool = True,
) -> DataFrame:
    """Pearson and Spearman correlation with p values per group.

    Ranks are joined back by value, and a double that is computed twice may differ in its last
    digit: the pairs are stored, so that each is computed once.
    """
    ranked = with_average_rank(materialize(_pairs(df, x, y, by)), by, "_x", "_rx")
    ranked = with_average_rank(ranked, by, "_y", "_ry")
    agg = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *_constant_sides(),
        _corr("_x", "_y").alias("_r"), _corr("_rx", "_ry").alias("_s"),
    ).withColumn("status", _status())
    ok = F.col("status") == "ok"
    out = agg.select(
        *by, "n",
        F.when(ok, F.col("_r")).alias("pearson_r"),
        F.when(ok, F.col("_s")).alias("spearman_r"),
        "status",
    )
    if not p_values:
        return out
    p = _p_value()
    return out.select(
        *by, "n", "pearson_r", p("pearson_r", F.col("n").cast("double")).alias("pearson_p"),
        "spearman_r", p("spearman_r", F.col("n").cast("double")).alias("spearman_p"), "status",
    )


def pearson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson correlation and its p value; one aggregation, no ranks."""
    agg = _pairs(df, x, y, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), _corr("_x", "_y").alias("pearson_r")
    ).withColumn("pearson_r", F.when(F.col("n") >= 3, F.col("pearson_r")))
    return agg.withColumn("pearson_p", _p_value()("pearson_r", F.col("n").cast("double")))


def correlation_grid(
    residuals: DataFrame, recovery: DataFrame, p_values: bool = True
) -> DataFrame:
    """Correlation for every (component, attack): long residuals joined to long recovery."""
    joined = residuals.join(recovery, "entity")
    return correlate(joined, "sim", "score", ["component", "attack"], p_values)


def trend_line(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least-squares slope and intercept; NULL when x is constant."""
    slope = F.covar_pop("_x", "_y") / F.nullif(F.var_pop("_x"), F.lit(0.0))
    return _pairs(df, x, y, by).groupBy(*by).agg(
        slope.alias("slope"), (F.avg("_y") - slope * F.avg("_x")).alias("intercept")
    )
