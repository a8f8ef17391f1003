"""Linear CKA and everything that follows from paired moments of activations.

One scan turns (x, y) rows into moment vectors per group (and per unit where needed); see
`functions.kernels`.  No n x n matrix and no pair of rows is ever formed, the shuffle
carries partial states only, and a group may be spread over any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer

from remnant.functions import kernels as K
from remnant.functions.common import hash_key, hash_uniform
from remnant.operators.wide import tiled_cka
from remnant.sources.storage import discard, materialize, stored

PROFILE = ["run", "component", "layer"]
MIN_ITEMS = 4
TASKS = 64  # whose partial states are added up together


def _fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


_DOUBLES = T.ArrayType(T.DoubleType())
_MOMENTS = [
    T.StructField("p", T.IntegerType()),
    T.StructField("q", T.IntegerType()),
    T.StructField("cx", _DOUBLES),
    T.StructField("cy", _DOUBLES),
    T.StructField("t", _DOUBLES),
]


def _map(df: DataFrame, schema: T.StructType, make, *args, **kw) -> DataFrame:
    return df.mapInArrow(make(*args, schema=to_arrow_schema(schema), **kw), schema)


# -- inputs ----------------------------------------------------------------------------
def align_activations(acts: DataFrame, base_run, min_n: int | None = None) -> DataFrame:
    """Vectors of the base run (x) beside each other run (y), by component, layer and item."""
    base = acts.filter(F.col("run") == base_run).select(
        "component", "layer", "item_id", F.col("vec").alias("x")
    )
    runs = acts.filter(F.col("run") != base_run).withColumnRenamed("vec", "y")
    base = base.withColumnsRenamed({c: f"_{c}" for c in ("component", "layer", "item_id")})
    # Pooled vectors have no layer: NULL equals NULL there.
    same = (F.col("component") == F.col("_component")) & F.col("layer").eqNullSafe(F.col("_layer")) & (F.col("item_id") == F.col("_item_id"))
    pairs = runs.join(base, same).filter(
        F.size("x") == F.size("y")
    ).select("run", "component", "layer", "item_id", "entity", "split", "x", "y")
    if min_n is None:
        return pairs
    enough = pairs.groupBy(*PROFILE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)
    return pairs.join(enough.select(*PROFILE), PROFILE, "left_semi")


def mean_vector(c: str) -> Column:
    """Element-wise mean of an array column, aggregated in the JVM with partial states."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(c))))


# -- moments ---------------------------------------------------------------------------
def paired_moments(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Moment vector per key: keys, p, q, cx, cy, t."""
    schema = T.StructType(_fields(pairs, keys) + _MOMENTS)
    rows = pairs.select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    partial = _map(rows, schema, K.moment_partials, keys)
    return merge_moments(partial, keys)


def merge_moments(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the partial states of each key: first those of TASKS neighbouring tasks, then the sums.

    So a key that all input tasks hold never sends all their states to one task.
    """
    schema = T.StructType(_fields(partial, keys) + _MOMENTS)
    near = partial.select(*schema.names, F.floor(F.spark_partition_id() / TASKS).cast("int").alias("_near"))
    return _merged(_merged(near, [*keys, "_near"]), keys)


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    schema = T.StructType(_fields(rows, keys) + _MOMENTS)
    placed = rows.select(*schema.names).repartition(*[F.col(k) for k in keys])
    return _map(placed.sortWithinPartitions(*keys), schema, K.merge_moments, keys)


def moments_to_cka(moments: DataFrame, keep: list[str]) -> DataFrame:
    schema = T.StructType(
        _fields(moments, keep)
        + [
            T.StructField("n", T.DoubleType()),
            T.StructField("biased", T.DoubleType()),
            T.StructField("debiased", T.DoubleType()),
        ]
    )
    out = _map(moments.select(*keep, "p", "q", "t"), schema, K.moments_to_cka, keep)
    return out.withColumn("n", F.col("n").cast("bigint"))


# -- CKA tables ------------------------------------------------------------------------
def cka(pairs: DataFrame, by: list[str] | None = None, kind: str = "debiased", tile: int | None = None) -> DataFrame:
    """Linear CKA per group: by, n, cka.  `kind` is "debiased" or "biased".

    tile: for widths of hundreds and more, products of column tiles of that width in place of
    moments, whose state grows with the square of the width.
    """
    by = by or PROFILE
    out = moments_to_cka(paired_moments(pairs, by), by) if tile is None else tiled_cka(pairs, by, tile=tile)
    return out.select(*by, "n", F.col(kind).alias("cka"))


def component_profile(pairs: DataFrame, kind: str = "debiased", min_n: int = MIN_ITEMS, tile: int | None = None) -> DataFrame:
    """CKA of each (run, component, layer); groups below min_n rows are left out."""
    return cka(pairs, PROFILE, kind, tile).filter(F.col("n") >= min_n)


def component_summary(profile: DataFrame, by=("run", "component")) -> DataFrame:
    return profile.groupBy(*by).agg(
        F.avg("cka").alias("mean_cka"), F.count("cka").alias("n_layers")
    )


def layer_profile(profile: DataFrame) -> DataFrame:
    """Layers in integer order beside the mean over the run's layers."""
    layers = profile.withColumn("layer", F.col("layer").cast("int"))
    mean = F.avg("cka").over(Window.partitionBy("run", "component"))
    return layers.select("run", "component", "layer", "cka", mean.alias("aggregate"))


def layer_pooling(acts: DataFrame) -> DataFrame:
    """Mean of a component's layer vectors per item: one row per run, component, item."""
    keys = ["run", "component", "item_id", "entity", "split"]
    return acts.groupBy(*keys).agg(mean_vector("vec").alias("vec")).withColumn(
        "layer", F.lit(0)
    )


def token_pooling(tokens: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """mean, first or last token vector per item."""
    if mode == "mean":
        pooled = mean_vector("vec")
    else:
        pooled = (F.min_by if mode == "first" else F.max_by)("vec", "pos")
    return tokens.groupBy(*keys).agg(pooled.alias("vec"))


def pooling_sensitivity(summary_a: DataFrame, summary_b: DataFrame) -> DataFrame:
    a = summary_a.select("run", "component", F.col("mean_cka").alias("a"))
    b = summary_b.select("run", "component", F.col("mean_cka").alias("b"))
    return a.join(b, ["run", "component"]).select(
        "run", "component", F.abs(F.col("a") - F.col("b")).alias("abs_diff")
    )


def selectivity(profile: DataFrame) -> DataFrame:
    """Forget and retain CKA per component, from a profile that keeps the split."""

    def of(split: str) -> Column:
        return F.avg(F.when(F.col("split") == split, F.col("cka")))

    return profile.groupBy("run", "component").agg(
        of("forget").alias("forget_cka"), of("retain").alias("retain_cka")
    ).withColumn("diff", F.col("retain_cka") - F.col("forget_cka"))


def cosine(a: Column, b: Column) -> Column:
    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)

    dot = total(F.zip_with(a, b, lambda u, v: u * v))
    norm = F.sqrt(total(F.transform(a, lambda u: u * u))) * F.sqrt(
        total(F.transform(b, lambda v: v * v))
    )
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(norm > 0, dot / norm)))


def entity_residual(pairs: DataFrame) -> DataFrame:
    """Cosine of the entity mean vectors of both runs at the last layer of each component."""
    last = pairs.groupBy("run", "component").agg(F.max("layer").alias("layer"))
    means = (
        pairs.join(last, ["run", "component", "layer"], "left_semi")
        .groupBy("run", "component", "entity")
        .agg(mean_vector("x").alias("x"), mean_vector("y").alias("y"))
    )
    return means.select("run", "component", "entity", cosine(F.col("x"), F.col("y")).alias("sim"))


def influence_loeo(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """CKA without one entity, minus the full CKA, by subtracting the entity's moments."""
    by = by or PROFILE
    units = paired_moments(pairs, [*by, "entity"])
    groups = merge_moments(units, by).select(
        *by, *[F.col(c).alias(f"g_{c}") for c in ("cx", "cy", "t")]
    )
    joined = units.join(groups, by)
    keep = [*by, "entity"]
    schema = T.StructType(
        _fields(joined, keep)
        + [T.StructField("full", T.DoubleType()), T.StructField("cka_without", T.DoubleType())]
    )
    out = _map(joined, schema, K.leave_one_out, keep)
    return out.select(*keep, "cka_without", (F.col("cka_without") - F.col("full")).alias("influence"))


def matrix_health(acts: DataFrame, n_expected: int | None = None, dead: float = 1e-10) -> DataFrame:
    """Shape, NaN and dead-matrix checks per run and component and layer."""
    nan = F.exists("vec", lambda v: F.isnan(v))
    peak = F.array_max(F.transform("vec", lambda v: F.abs(v)))
    t = acts.groupBy(*PROFILE).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("vec")).alias("dim_min"),
        F.max(F.size("vec")).alias("dim_max"),
        F.count_if(nan).alias("n_nan"),
        F.max(F.when(~nan, peak)).alias("max_abs"),
    )
    wrong = F.lit(False) if n_expected is None else F.col("n") != n_expected
    verdict = (
        F.when(wrong | (F.col("dim_min") != F.col("dim_max")) | (F.col("n_nan") > 0), "FAIL")
        .when(F.col("max_abs") < dead, "WARN")
        .otherwise("PASS")
    )
    return t.withColumn("verdict", verdict)


def discriminative_units(acts: DataFrame, share: float, by: tuple[str, ...] = ("component", "layer")) -> DataFrame:
    """Units with the largest |sum over forget - sum over retain|, top share per layer."""
    sign = F.when(F.col("split") == "forget", F.lit(1.0)).otherwise(F.lit(-1.0))
    signed = acts.withColumn("_s", sign).withColumn(
        "vec", F.transform("vec", lambda v: v * F.col("_s"))
    )
    # Element-wise sums in the JVM; only then one row per unit.
    sums = signed.groupBy(*by).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("vec")))).alias("total")
    )
    units = sums.select(*by, F.size("total").alias("_n"), F.posexplode("total").alias("unit", "v"))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "unit")
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(share))))
    return (
        units.withColumn("score", F.abs("v"))
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select(*by, "unit", "score", "rank")
    )


def weight_health(weights: DataFrame, atol: float = 1e-8) -> DataFrame:
    """Adapter B tensors per checkpoint: how many, how many active, all finite, peak."""
    b = weights.filter(F.contains(F.lower("tensor"), F.lit("lora_b")))
    bad = F.exists("values", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    peak = F.array_max(F.transform("values", lambda v: F.abs(v.cast("double"))))
    found = b.select("checkpoint", bad.alias("bad"), F.when(~bad, peak).alias("peak")).groupBy(
        "checkpoint"
    ).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("peak") > atol).alias("nonzero"),
        F.bool_and(~F.col("bad")).alias("finite"),
        F.max("peak").alias("max_abs"),
    )
    all_ = weights.select("checkpoint").distinct()
    out = all_.join(found, "checkpoint", "left").na.fill(0, ["total", "nonzero"])
    ok = (F.col("total") > 0) & (F.col("nonzero") > 0) & F.col("finite")
    return out.withColumn("finite", F.coalesce("finite", F.lit(True))).withColumn(
        "verdict", F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")
    )


def weight_drift(weights: DataFrame, snapshot: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """Mean squared difference to a snapshot over the tensors whose name holds a prefix."""
    w = weights
    if prefixes:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.contains(F.col("tensor"), F.lit(p))
        w = w.filter(hit)
    s = snapshot.select("tensor", F.col("values").alias("old"))
    sq = F.aggregate(
        F.zip_with("values", "old", lambda a, b: (a.cast("double") - b.cast("double"))),
        F.lit(0.0),
        lambda acc, d: acc + d * d,
    )
    return w.join(s, "tensor").groupBy("checkpoint").agg(
        (F.sum(sq) / (F.sum(F.size("values")) + F.lit(1e-8))).alias("drift")
    )


def entity_disjoint_probe(
    acts: DataFrame, label: str, by: list[str] | None = None, folds: int = 2, ridge: float = 1e-3
) -> DataFrame:
    """Linear probe whose folds never share an entity: by, fold, n, accuracy.

    A 0/1 label is fitted by ridge-damped least squares on the other folds and cut at one half.
    All groups and folds are fitted in one pass: their moments are summed by fold, and a fold's
    equations are those of the others added up.  A fold without others gives no row.
    """
    by = by or PROFILE
    rows = acts.select(
        *by, F.col("vec").alias("x"), F.col(label).cast("double").alias("label"),
        F.pmod(F.xxhash64(F.col("entity").cast("string")), F.lit(folds)).cast("int").alias("fold"),
    ).filter("label is not null")
    own = paired_moments(rows.withColumn("y", F.array("label")), [*by, "fold"])
    others = own.withColumnRenamed("fold", "_own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    train = merge_moments(others.filter("fold <> _own").drop("_own"), [*by, "fold"])
    keep = [*by, "fold"]
    schema = T.StructType(_fields(train, keep) + [T.StructField("w", _DOUBLES)])
    weights = _map(train.select(*keep, "p", "q", "cx", "cy", "t"), schema, K.linear_probe, keep, ridge=ridge)
    weights = weights.withColumnsRenamed({k: f"_{k}" for k in keep})
    same = F.lit(True)
    for k in keep:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    terms = F.zip_with(F.concat("x", F.array(F.lit(1.0))), "w", lambda a, b: a * b)
    score = F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)
    scored = rows.join(weights, same).select(*keep, ((score >= 0.5).cast("double") == F.col("label")).alias("hit"))
    return scored.groupBy(*keep).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("accuracy"))


def logistic_probe(
    acts: DataFrame, label: str, by: list[str] | None = None, folds: int = 2, ridge: float = 1e-3,
    tol: float = 1e-10, rounds: int = 50,
) -> DataFrame:
    """Logistic probe whose folds never share an entity: by, fold, n, accuracy, log_loss, weights.

    Each fold is judged by the ridge-damped logistic regression of the other folds on a 0/1 label.
    A round is one pass: loss, gradient and Hessian of all groups and folds are summed in tasks
    and added up, and only these sums are shuffled.  A row of a fold that has no others is not
    judged; NULL labels are left out; the intercept is the last weight and not damped.  Folds
    come from md5 of the entity.  Where the other
    folds hold labels of one kind, the intercept is large but finite.  A fit that has not settled
    after `rounds` stops the call.
    """
    by = by or PROFILE
    spark, keep = acts.sparkSession, [*by, "fold"]
    rows = materialize(acts.select(
        *by, F.col("vec").alias("x"), F.col(label).cast("double").alias("label"),
        hash_uniform(hash_key("fold", "entity"), F.lit(folds)).cast("int").alias("own"),
    ).filter("label is not null"))
    train = rows.withColumn("fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("own"))))
    zeros = F.array_repeat(F.lit(0.0), F.max(F.size("x")) + 1)
    start = train.groupBy(*keep).agg(zeros.alias("base")).withColumn("w", F.col("base"))
    state = start.withColumn("best", F.lit(None).cast("double")).withColumn("done", F.lit(False))
    sums = T.StructType([*_fields(train, keep), T.StructField("t", _DOUBLES)])
    after = T.StructType([f for f in state.schema.fields])
    state, path = stored(state, "probe")
    for _ in range(rounds):
        open_ = state.filter("not done")
        here = _by_key(train, open_.select(*keep, "w"), keep).select(*keep, "x", "label", "w")
        near = _map(here, sums, K.logistic_partials, keep).withColumn("near", F.floor(F.spark_partition_id() / TASKS).cast("int"))
        total = _added(_added(near, sums, [*keep, "near"]), sums, keep)
        stepped = _map(
            _by_key(total, open_.select(*keep, "base", "w", "best"), keep).select(*keep, "base", "w", "best", "t"),
            after, K.newton_step, keep, ridge=ridge, tol=tol,
        )
        old = path
        state, path = stored(stepped.unionByName(state.filter("done")), "probe")
        discard(spark, old)
        if state.filter("not done").isEmpty():
            break
    else:
        raise RuntimeError(f"the logistic probe has not settled after {rounds} rounds")
    fitted = state.select(*keep, F.col("base").alias("weights"))
    judged = _by_key(rows.withColumnRenamed("own", "fold"), fitted, keep)
    terms = F.zip_with(F.concat("x", F.array(F.lit(1.0))), "weights", lambda a, b: a * b)
    judged = judged.withColumn("z", F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))
    hit = ((F.col("z") >= 0).cast("double") == F.col("label")).cast("double")
    loss = F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("label") * F.col("z")
    scores = judged.groupBy(*keep).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg(loss).alias("log_loss")
    )
    return _by_key(scores, fitted, keep).select(*keep, "n", "accuracy", "log_loss", "weights")


def _by_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which NULL keys are equal; the keys of the left side stay."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(right, same).drop(*[f"_{k}" for k in keys])


def _added(rows: DataFrame, schema: T.StructType, keys: list[str]) -> DataFrame:
    """Sums of the vectors `t` by key, in a stream over rows sorted by key."""
    schema = T.StructType([*_fields(rows, keys), schema["t"]])
    placed = rows.select(*schema.names).repartition(*[F.col(k) for k in keys])
    return _map(placed.sortWithinPartitions(*keys), schema, K.added_vectors, keys)
