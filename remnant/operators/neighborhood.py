"""Leakage into the neighbourhood of an entity and its controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remnant.functions import fixed_values as V


def entity_leakage(probes: DataFrame, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Mean leakage per relation, and the micro mean of the entity over all probes."""
    sums = probes.groupBy(*keys, "relation").agg(
        F.avg("leakage").alias("mean"), F.sum("leakage").alias("_s"), F.count("leakage").alias("n")
    )
    total = sums.groupBy(*keys).agg((F.sum("_s") / F.sum("n")).alias("entity_mean"), F.sum("n").alias("entity_n"))
    return sums.drop("_s").join(total, list(keys))


def cnis(
    probes: DataFrame, weights: dict[str, float] | None = None, keys: tuple[str, ...] = ("entity",)
) -> DataFrame:
    """1 - mean leakage: macro (weighted mean of relation means) and micro (over probes)."""
    rel = probes.groupBy(*keys, "relation").agg(
        F.avg("leakage").alias("m"), F.sum("leakage").alias("s"), F.count("leakage").alias("n")
    )
    weight: Column = F.lit(1.0)
    for relation, value in (weights or {}).items():
        weight = F.when(F.col("relation") == relation, F.lit(float(value))).otherwise(weight)
    rel = rel.filter(F.col("m").isNotNull()).withColumn("w", weight)
    return rel.groupBy(*keys).agg(
        (F.lit(1.0) - F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col("m")) / F.sum("w")).otherwise(F.lit(0.0))).alias("cnis_macro"),
        (F.lit(1.0) - F.sum("s") / F.sum("n")).alias("cnis_micro"),
    )


def cnis_summary(scores: DataFrame, by: tuple[str, ...] = (), value: str = "cnis_macro") -> DataFrame:
    """Mean, population standard deviation and range; NULL scores do not count."""
    v = F.col(value)
    return scores.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.count(v).alias("n"),
    )


def delta_band(delta: Column, signed: bool = True) -> Column:
    d = delta if signed else F.abs(delta)
    return (
        F.when(d >= V.CONTROL_DELTA_STRONG, "meaningful")
        .when(d >= V.CONTROL_DELTA_WEAK, "weak")
        .otherwise("none")
    )


def shuffled_control_summary(records: DataFrame, signed: bool = True) -> DataFrame:
    """Correct and shuffled score per entity, plus a total row (entity NULL) with its band."""
    per_entity = records.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("correct"),
        F.avg("shuffled_score").alias("shuffled"),
    ).withColumn("delta", F.col("correct") - F.col("shuffled"))
    total = per_entity.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("correct").alias("correct"),
        F.avg("shuffled").alias("shuffled"),
    ).withColumn("delta", F.col("correct") - F.col("shuffled"))
    total = total.select(
        F.lit(None).cast("string").alias("entity"), "n", "correct", "shuffled", "delta",
        delta_band(F.col("delta"), signed).alias("band"),
    )
    return per_entity.withColumn("band", F.lit(None).cast("string")).unionByName(total)
