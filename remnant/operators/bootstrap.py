"""Bootstrap intervals with resampling indices shared by all runs.

Draws come from md5 of (seed, replicate, slot), so every run and layer is resampled with
the same indices, whatever the partitioning.  Resampled rows are never materialized: draws
become counts per unit, and a replicate is a weighted sum of moments or values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remnant.functions import fixed_values as V
from remnant.functions import kernels as K
from remnant.functions.common import hash_uniform
from remnant.operators.ordering import with_position
from remnant.operators.similarity import (
    PROFILE, _MOMENTS, _fields, _map, merge_moments, moments_to_cka, paired_moments,
)

SEED = V.BOOTSTRAP_SEED
BLOCK = 125  # replicates that a task draws or finishes together
SLOTS = 1 << 16  # of a replicate that one task draws
ROWS = 1 << 14  # units of a tile, whose draws meet its rows in one task
BUCKETS = 16  # of groups that share a tile's draws, where there are few tiles


def indexed_units(units: DataFrame, unit: str, by: list[str] | None = None) -> DataFrame:
    """Distinct units with their index in sorted order and their number."""
    by = by or []
    distinct = units.select(*by, unit).distinct()
    return with_position(distinct, by, [unit], "unit_index", "n_units")


def draw_indices(
    units: DataFrame, unit: str, replicates: int, seed: int = SEED, by: list[str] | None = None,
) -> DataFrame:
    """As many draws as there are units in each replicate: replicate, slot, unit_index."""
    by = by or []
    # Numbered units are few bytes and would all stay in one task, which then makes every draw.
    numbered = indexed_units(units, unit, by).select(*by, "unit_index", "n_units").repartition(_tasks(units))
    slots = numbered.select(
        *by, F.col("unit_index").alias("slot"), "n_units",
        F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"),
    )
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("slot").cast("string")))
    return slots.select(*by, "replicate", "slot", hash_uniform(key, F.col("n_units")).alias("unit_index"))


def draw_counts(
    units: DataFrame, unit: str, replicates: int, seed: int = SEED, by: list[str] | None = None,
) -> DataFrame:
    """How often each unit is drawn: by, unit, replicate, w (units never drawn are absent)."""
    by = by or []
    counts = draw_indices(units, unit, replicates, seed, by).groupBy(
        *by, "replicate", "unit_index"
    ).agg(F.count(F.lit(1)).alias("w"))
    names = indexed_units(units, unit, by).select(*by, "unit_index", unit)
    return counts.join(names, [*by, "unit_index"]).select(*by, unit, "replicate", "w")


def _tasks(df: DataFrame) -> int:
    """Tasks for work that is much larger than the bytes it reads, which Spark would deal out by."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _packed(sizes: DataFrame, replicates: int, seed: int) -> DataFrame:
    """n_units, tile, r0, counts, places: the draws of each tile of ROWS units; see `packed_draws`.

    sizes: distinct n_units.  The draws are made inside tasks, one per block of replicates and range
    of slots, and take two bytes each.
    """
    jobs = (
        sizes.select("n_units", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(BLOCK))).alias("r0"))
        .select("n_units", "r0", F.least(F.col("r0") + BLOCK, F.lit(replicates)).alias("r1"), F.explode(F.sequence(F.lit(0), F.col("n_units") - 1, F.lit(SLOTS))).alias("s0"))
        .withColumn("s1", F.least(F.col("s0") + SLOTS, F.col("n_units")))
    )
    schema = T.StructType([
        T.StructField("n_units", T.LongType()), T.StructField("tile", T.LongType()), T.StructField("r0", T.IntegerType()),
        T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("places", T.BinaryType()),
    ])
    return _map(jobs.repartition(_tasks(sizes)), schema, K.packed_draws, seed, ROWS)


def _drawn(sizes: DataFrame, replicates: int, seed: int) -> DataFrame:
    """n_units, unit_index, r0, reps: the replicates of a block, counted from r0, that draw a unit."""
    schema = T.StructType([
        T.StructField("n_units", T.LongType()), T.StructField("unit_index", T.LongType()), T.StructField("r0", T.IntegerType()),
        T.StructField("reps", T.ArrayType(T.ShortType())),
    ])
    return _map(_packed(sizes, replicates, seed), schema, K.unpacked_draws, ROWS)


def _met(draws: DataFrame, rows: DataFrame, by: list[str], place: list[str]) -> DataFrame:
    """Draws of a tile (kind 0) and then its rows (kind 1), in one task per `place`, rows sorted by group.

    Union instead of a join: a tile's draws arrive once, and nothing is sent to all tasks.
    """
    index = F.col("unit_index")
    tiled = rows.withColumns({"tile": F.floor(index / F.lit(ROWS)), "place": (index % ROWS).cast("int"), "kind": F.lit(1)}).drop("unit_index")
    both = tiled.unionByName(draws.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    order = [*place, "kind", *by, "place", "r0"]
    return both.repartition(4 * _tasks(rows), *place).sortWithinPartitions(*order)


def cka_replicates(
    pairs: DataFrame, unit: str, replicates: int, seed: int = SEED, by: list[str] | None = None,
) -> DataFrame:
    """Debiased CKA of every replicate: by, replicate, value.

    unit="item_id" resamples items; any other unit (entities) takes all its items, whose
    moments are added up before the draws are applied.  Rows move once and meet the draws of their
    tile of ROWS units, in a task that adds up all replicates.  Groups of one tile are finished
    there; the moments of others are added up across tiles.
    """
    by = by or PROFILE
    from_moments = unit != "item_id"
    rows = paired_moments(pairs, [*by, unit]) if from_moments else pairs.select(*by, unit, "x", "y")
    units = indexed_units(pairs, unit)
    sizes = units.select("n_units").distinct()
    tiles = -(-(sizes.first() or [0])[0] // ROWS)
    buckets = max(1, min(BUCKETS, _tasks(pairs)) // max(1, tiles))
    draws = _packed(sizes, replicates, seed).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    placed = rows.join(units, unit).drop(unit).withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    met = _met(draws, placed, by, ["n_units", "tile", "bucket"])
    kept = _fields(rows, by) + [T.StructField("replicate", T.IntegerType())]
    finish = tiles <= 1
    schema = T.StructType(kept + ([T.StructField("value", T.DoubleType())] if finish else _MOMENTS))
    out = _map(met, schema, K.replicate_moments, by, n_replicates=replicates, rows=ROWS, from_moments=from_moments, finish=finish)
    if finish:
        return out
    keys = [*by, "replicate"]
    return moments_to_cka(merge_moments(out, keys), keys).select(*keys, F.col("debiased").alias("value"))


def percentile_interval(replicates: DataFrame, by: list[str], alpha: float = V.BOOTSTRAP_ALPHA, value: str = "value") -> DataFrame:
    """Linear-interpolated percentile interval; NULL below two defined replicates.

    A group holds one row per replicate, which bounds the exact percentile's state.
    """
    n = F.count(value)
    lo = F.percentile(value, F.lit(alpha / 2))
    hi = F.percentile(value, F.lit(1 - alpha / 2))
    return replicates.groupBy(*by).agg(
        F.when(n >= 2, lo).alias("lo"), F.when(n >= 2, hi).alias("hi"), n.alias("n_ok")
    )


def cka_bootstrap(pairs: DataFrame, unit: str, replicates: int, seed: int = SEED,
                  alpha: float = V.BOOTSTRAP_ALPHA, by: list[str] | None = None) -> DataFrame:
    by = by or PROFILE
    return percentile_interval(cka_replicates(pairs, unit, replicates, seed, by), by, alpha)


def value_replicates(
    values: DataFrame, unit: str, value: str, replicates: int, seed: int = SEED,
    by: list[str] | None = None, min_n: int = 4,
) -> DataFrame:
    """Replicate means of a scalar per unit; groups with fewer than min_n values are left out."""
    by = by or []
    rows = values.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    units = indexed_units(rows, unit, by)
    # Groups with as many units share their draws.
    draws = _packed(units.select("n_units").distinct(), replicates, seed)
    placed = rows.select(*by, unit, F.col(value).cast("double").alias("value")).join(units, [*by, unit]).drop(unit)
    schema = T.StructType(
        _fields(rows, by) + [T.StructField("replicate", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ("n", "total")]
    )
    met = _met(draws, placed, by, ["n_units", "tile"])
    out = _map(met, schema, K.replicate_sums, by, rows=ROWS).groupBy(*by, "replicate").agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("value")
    )
    return out.filter(F.col("n") >= min_n).drop("n")


def value_bootstrap(values: DataFrame, unit: str, value: str, replicates: int, seed: int = SEED,
                    by: list[str] | None = None, alpha: float = V.BOOTSTRAP_ALPHA, min_n: int = 4) -> DataFrame:
    reps = value_replicates(values, unit, value, replicates, seed, by, min_n)
    return percentile_interval(reps, by or [], alpha)


def layer_mean_replicates(replicates: DataFrame) -> DataFrame:
    """Mean over a component's layers within each replicate (same draws for every layer)."""
    return replicates.groupBy("run", "component", "replicate").agg(F.avg("value").alias("value"))


def cluster_vs_example(example: DataFrame, cluster: DataFrame, by: list[str]) -> DataFrame:
    """Widths of both intervals; wider is NULL when one is undefined."""
    e = example.select(*by, (F.col("hi") - F.col("lo")).alias("width_example"))
    c = cluster.select(*by, (F.col("hi") - F.col("lo")).alias("width_cluster"))
    return e.join(c, by).withColumn(
        "cluster_wider", F.col("width_cluster") > F.col("width_example")
    )


def paired_difference(replicates: DataFrame, by: list[str], alpha: float = V.BOOTSTRAP_ALPHA) -> DataFrame:
    """Difference of two runs within each replicate: mean, interval, excludes zero."""
    a = replicates.select(*by, "replicate", F.col("run").alias("run_a"), F.col("value").alias("va"))
    b = replicates.select(*by, "replicate", F.col("run").alias("run_b"), F.col("value").alias("vb"))
    diff = a.join(b, [*by, "replicate"]).filter(F.col("run_a") < F.col("run_b")).withColumn(
        "value", F.col("va") - F.col("vb")
    )
    keys = [*by, "run_a", "run_b"]
    means = diff.groupBy(*keys).agg(
        F.avg("value").alias("mean_diff"),
        F.percentile("value", F.lit(alpha / 2)).alias("lo"),
        F.percentile("value", F.lit(1 - alpha / 2)).alias("hi"),
    )
    return means.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


def ci_audit(
    replicates: DataFrame, stored: DataFrame, by: list[str], expected_unit: str = "examples",
    expected_n: int | None = None, alpha: float = V.BOOTSTRAP_ALPHA, tolerance: float = 1e-10,
) -> DataFrame:
    """Recompute stored intervals from their replicates and judge them.

    `stored` holds by, point, lo, hi, n_bootstrap and optionally unit, n_samples, paired.
    """
    v = F.col("value")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    t = replicates.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_replicates"),
        F.count_if(bad).alias("n_bad"),
        F.avg(v).alias("mean"),
        F.median(v).alias("median"),
        F.stddev_samp(v).alias("sd"),
        F.percentile(v, F.lit(alpha / 2)).alias("pct_lo"),
        F.percentile(v, F.lit(1 - alpha / 2)).alias("pct_hi"),
    )
    j = stored.join(t, by, "left")

    def given(name: str):
        return F.col(name) if name in stored.columns else None

    provenance = F.lit(True)
    if given("unit") is not None:
        provenance = provenance & F.coalesce(F.col("unit") == expected_unit, F.lit(False))
    if given("n_samples") is not None and expected_n is not None:
        provenance = provenance & F.coalesce(F.col("n_samples") == expected_n, F.lit(False))
    if given("paired") is not None:
        provenance = provenance & F.coalesce(F.col("paired"), F.lit(False))
    usable = (
        provenance
        & F.coalesce(F.col("n_replicates") == F.col("n_bootstrap"), F.lit(False))
        & F.coalesce(F.col("n_bad") == 0, F.lit(False))
    )
    inside = (F.col("pct_lo") <= F.col("point")) & (F.col("point") <= F.col("pct_hi"))
    matches = (F.abs(F.col("lo") - F.col("pct_lo")) < tolerance) & (
        F.abs(F.col("hi") - F.col("pct_hi")) < tolerance
    )
    verdict = (
        F.when(~usable | ~F.coalesce(matches, F.lit(False)), "FAIL").when(~inside, "WARN").otherwise("PASS")
    )
    return j.select(
        *by, "point", "mean", "median", "sd", (F.col("mean") - F.col("point")).alias("bias"),
        "pct_lo", "pct_hi",
        (2 * F.col("point") - F.col("pct_hi")).alias("basic_lo"),
        (2 * F.col("point") - F.col("pct_lo")).alias("basic_hi"),
        inside.alias("point_inside"), matches.alias("stored_matches"), verdict.alias("verdict"),
    )
