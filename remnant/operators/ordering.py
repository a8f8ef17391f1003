"""Positions, neighbours and ranks within a group, without putting a group into one task.

Rows are range-partitioned by (group, order), so that a group holding most of the rows fills as
many ranges as it needs.  The rows with their range are stored once; then rows are counted per
(group, range), and the counts of earlier ranges are added to the position inside the range.
There is one path for all sizes; small inputs simply end up in one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from remnant.sources.storage import materialize


def _ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the number of their range in the order of `keys`.

    Stored, so that every branch of a plan, and a lost task that runs again, sees the same cuts.
    """
    return materialize(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))


def with_position(
    df: DataFrame,
    group: list[str],
    order: list[str],
    pos: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Zero-based position of each row in its group, and optionally the group size.

    `order` must be a total order.
    """
    cut = _ranged(df, [*group, *order])
    counts = cut.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group,
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(w).alias("_total"),
    )
    local = Window.partitionBy(*group, "_range").orderBy(*order)
    out = _null_safe_join(
        cut.withColumn("_local", F.row_number().over(local).cast("bigint") - 1),
        offsets,
        [*group, "_range"],
    ).withColumn(pos, F.col("_local") + F.col("_before"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_local", "_before", "_total", "_range")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how="inner") -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])


def with_neighbor(
    df: DataFrame,
    group: list[str],
    order: list[str],
    take: dict[str, str],
    step: int = 1,
    wrap: bool = True,
) -> DataFrame:
    """Columns of the row `step` places further in its group; the last wraps to the first.

    The neighbour is found by an equality join on (group, position), so its keys are unique.
    """
    placed = with_position(df, group, order, "_pos", "_size")
    target = F.col("_pos") + step
    if wrap:
        target = F.pmod(target, F.col("_size"))
    other = placed.select(
        *group,
        F.col("_pos").alias("_target"),
        *[F.col(src).alias(name) for src, name in take.items()],
    )
    return _null_safe_join(
        placed.withColumn("_target", target), other, [*group, "_target"], "left"
    ).drop("_pos", "_size", "_target")


def with_average_rank(
    df: DataFrame, group: list[str], value: str, rank: str
) -> DataFrame:
    """Average rank of ties, from counts of equal values (aggregated before any sort)."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_ties"))
    cut = _ranged(counts, [*group, value])
    sums = cut.groupBy(*group, "_range").agg(F.sum("_ties").alias("_n"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    offsets = sums.select(
        *group,
        "_range",
        F.coalesce(
            F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
    )
    local = Window.partitionBy(*group, "_range").orderBy(value)
    inside = F.coalesce(
        F.sum("_ties").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    ranks = _null_safe_join(
        cut.withColumn("_inside", inside), offsets, [*group, "_range"]
    ).withColumn("_before", F.col("_inside") + F.col("_offset"))
    ranks = ranks.select(
        *group, value, (F.col("_before") + (F.col("_ties") + 1) / F.lit(2.0)).alias(rank)
    )
    return _null_safe_join(df, ranks, [*group, value])
