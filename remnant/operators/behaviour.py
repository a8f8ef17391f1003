"""Accuracy, suppression, recovery and verdict tables from predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remnant.functions import fixed_values as V
from remnant.functions.common import ratio, share
from remnant.operators.ordering import with_position


def _split(name: str) -> Column:
    return F.col("split") == name


def _rate(cond: Column, where: Column) -> Column:
    return F.avg(F.when(where, cond.cast("double")))


def score_summary(predictions: DataFrame, by: list[str]) -> DataFrame:
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("correct")).alias("correct_rate"),
        share(F.col("refusal")).alias("refusal_rate"),
    )


def behaviour_table(predictions: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Forget and retain accuracy per run in one pass."""
    correct = F.col("correct")
    return predictions.groupBy(*by).agg(
        _rate(correct, _split("forget")).alias("forget_acc"),
        (1 - _rate(correct, _split("forget"))).alias("forget_rate"),
        _rate(correct, _split("retain")).alias("retain_acc"),
        F.count_if(_split("forget")).alias("forget_n"),
        F.count_if(_split("retain")).alias("retain_n"),
    )


def attack_rates(predictions: DataFrame, attacks=tuple(V.ATTACKS), micro: bool = False) -> DataFrame:
    """Success rate per attack and the mean of the rates.

    Macro: mean over the rows of the attack.  Micro: rephrase hits over rephrased questions,
    every other attack over the items.
    """
    correct = F.col("correct").cast("double")
    hits = [F.sum(F.when(F.col("attack") == a, correct)).alias(f"_h_{a}") for a in attacks]
    rows = [F.count_if(F.col("attack") == a).alias(f"_n_{a}") for a in attacks]
    agg = predictions.groupBy("run").agg(
        *hits, *rows, F.countDistinct("item_key").alias("n_items")
    )

    def rate(a: str) -> Column:
        hit = F.coalesce(F.col(f"_h_{a}"), F.lit(0.0)) if micro else F.col(f"_h_{a}")
        over_items = micro and a != "rephrase"
        return ratio(hit, F.col("n_items") if over_items else F.col(f"_n_{a}"))

    rates = agg.select("run", *[rate(a).alias(a) for a in attacks], "n_items")
    total = sum((F.col(a) for a in attacks), F.lit(0.0))
    return rates.withColumn("mean_recovery", total / F.lit(float(len(attacks))))


def entity_recovery(
    predictions: DataFrame, order: list[str], attacks=tuple(V.VISUAL_RECOVERY_ATTACKS)
) -> DataFrame:
    """Recovery per entity and attack; the last item of an entity counts.

    An attack without rows scores 0; the mean covers all listed attacks.
    """
    last = predictions.groupBy("run", "entity").agg(
        F.max_by("item_key", F.struct(*order)).alias("item_key")
    )
    rows = predictions.join(last, ["run", "entity", "item_key"], "left_semi")
    wide = rows.groupBy("run", "entity").agg(
        *[
            F.coalesce(F.avg(F.when(F.col("attack") == a, F.col("score"))), F.lit(0.0)).alias(a)
            for a in attacks
        ]
    )
    total = sum((F.col(a) for a in attacks), F.lit(0.0))
    wide = wide.withColumn("mean", total / F.lit(float(len(attacks))))
    return wide.unpivot(["run", "entity", "mean"], list(attacks), "attack", "score").select(
        "run", "entity", "attack", "score", "mean"
    )


def flip_category(split="split", base="base_correct", method="method_correct") -> Column:
    out = None
    for s, cases in V.FLIP_CATEGORIES.items():
        for (b, m), name in cases.items():
            cond = (F.col(split) == s) & (F.col(base) == b) & (F.col(method) == m)
            out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def flip_counts(aligned: DataFrame) -> DataFrame:
    """Counts of the four flip categories of each split, zero when none occur."""
    counts = (
        aligned.withColumn("category", flip_category()).groupBy("run", "split").pivot(
            "category", [c for cases in V.FLIP_CATEGORIES.values() for c in cases.values()]
        ).agg(F.count(F.lit(1)))
    )
    names = {s: list(c.values()) for s, c in V.FLIP_CATEGORIES.items()}
    lists = [
        F.when(
            F.col("split") == s,
            F.array(
                *[
                    F.struct(F.lit(c).alias("category"), F.coalesce(c, F.lit(0)).alias("n"))
                    for c in cats
                ]
            ),
        )
        for s, cats in names.items()
    ]
    return counts.select("run", "split", F.explode(F.coalesce(*lists)).alias("x")).select(
        "run", "split", "x.category", "x.n"
    )


def suppressed_rows(aligned: DataFrame, split: str = "forget") -> DataFrame:
    """Items right in the base run and wrong in the other run, one row each."""
    return aligned.filter(
        _split(split) & F.col("base_correct") & ~F.col("method_correct")
    ).select("run", "item_key")


def suppressed_items(aligned: DataFrame) -> DataFrame:
    """Number of suppressed items per run; `suppressed_rows` has the items."""
    counts = suppressed_rows(aligned).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return aligned.select("run").distinct().join(counts, "run", "left").select(
        "run", F.coalesce("n", F.lit(0)).alias("n_suppressed")
    )


def recovered_of_suppressed(aligned: DataFrame, attacked: DataFrame) -> DataFrame:
    """Of the suppressed items, those right under any rephrased attack row."""
    right = attacked.groupBy("run", "item_key").agg(F.bool_or("correct").alias("recovered"))
    runs = aligned.select("run").distinct()
    counts = (
        suppressed_rows(aligned)
        .join(right, ["run", "item_key"], "left")
        .groupBy("run")
        .agg(
            F.count(F.lit(1)).alias("n_suppressed"),
            F.count_if(F.coalesce("recovered", F.lit(False))).alias("n_recovered"),
        )
    )
    return runs.join(counts, "run", "left").na.fill(0, ["n_suppressed", "n_recovered"])


def prompt_occurrence(
    predictions: DataFrame, order: list[str]
) -> DataFrame:
    """Accuracy by split and k-th prompt of an entity."""
    placed = with_position(
        predictions, ["run", "split", "entity"], order, "_pos"
    )
    return (
        placed.withColumn("occurrence", F.col("_pos") + 1)
        .groupBy("run", "split", "occurrence")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("correct").alias("correct"),
            share(F.col("correct")).alias("accuracy"),
        )
    )


def behaviour_deltas(table: DataFrame, base_run: str) -> DataFrame:
    base = table.filter(F.col("run") == base_run)

    def delta(c: str) -> Column:
        # One value, read once; the base run differs from itself by exactly zero.
        change = F.col(c) - base.agg(F.max(c)).scalar()
        return F.when(F.col("run") == base_run, change * 0.0).otherwise(change)

    return table.select(
        "run", "forget_acc", "retain_acc",
        delta("forget_acc").alias("delta_forget"), delta("retain_acc").alias("delta_retain"),
    )


def regime(
    deltas: DataFrame, tolerance: float = V.RETAIN_TOLERANCE, collapse: float = V.COLLAPSE_RETAIN_DROP
) -> DataFrame:
    """Name of the effect of a run, from its accuracy changes; rules apply in this order."""
    df_, dr = F.col("delta_forget"), F.col("delta_retain")
    kept = dr >= -abs(tolerance)
    name = (
        F.when(dr <= -abs(collapse), "COLLAPSE_OR_SEVERE_UTILITY_DAMAGE")
        .when((df_ < 0) & kept, "DIRECTIONAL_SELECTIVE_FORGETTING")
        .when((F.abs(df_) < 1e-12) & kept, "UNDER_FORGETTING")
        .when((df_ < 0) & ~kept, "FORGETTING_WITH_UTILITY_DAMAGE")
        .when(df_ > 0, "UNEXPECTED_RECOVERY_OR_RELEARNING")
        .otherwise("NO_CLEAR_SELECTIVE_EFFECT")
    )
    return deltas.withColumn("regime", name).select(
        "run",
        "regime",
        F.when(F.col("regime") == "DIRECTIONAL_SELECTIVE_FORGETTING", "PASS")
        .otherwise("WARN")
        .alias("verdict"),
    )


def collapse_by_run(predictions: DataFrame) -> DataFrame:
    """Share of collapsed generations per run; collapsed when most items are, in any split."""
    per_split = predictions.groupBy("run", "split").agg(
        share(F.col("collapsed")).alias("collapse_fraction")
    )
    return per_split.groupBy("run").agg(
        F.max("collapse_fraction").alias("collapse_fraction"),
        F.bool_or(F.col("collapse_fraction") > V.COLLAPSE_ITEM_FRACTION).alias("collapsed"),
    )


def sweep_verdict(deltas: DataFrame, collapse: DataFrame) -> DataFrame:
    reason = (
        F.when(F.col("collapsed"), "generation collapse detected")
        .when(F.col("delta_retain") < -V.RETAIN_TOLERANCE, "retain accuracy below tolerance")
        .when(F.col("delta_forget") < -V.FORGET_GAIN, "forget accuracy improved while retain utility was preserved")
        .otherwise("no meaningful forget-accuracy improvement")
    )
    verdict = (
        F.when(F.col("collapsed") | (F.col("delta_retain") < -V.RETAIN_TOLERANCE), "FAIL")
        .when(F.col("delta_forget") < -V.FORGET_GAIN, "PASS")
        .otherwise("WARN")
    )
    joined = deltas.join(collapse.select("run", "collapsed"), "run", "left").withColumn(
        "collapsed", F.coalesce("collapsed", F.lit(False))
    )
    return joined.select("run", verdict.alias("verdict"), reason.alias("reason"))


def best_config(table: DataFrame) -> DataFrame:
    """Run with the lowest forget accuracy (name breaks ties) and what it achieves."""
    row = F.struct("run", "forget_acc", "retain_acc")
    best = table.filter(F.col("forget_acc").isNotNull()).agg(
        F.min_by(row, F.struct("forget_acc", "run")).alias("b")
    )
    forgot = F.col("b.forget_acc") < V.SELECTIVE_FORGET_BELOW
    label = (
        F.when(forgot & (F.col("b.retain_acc") > V.SELECTIVE_RETAIN_ABOVE), "selective")
        .when(forgot, "retain_damaged")
        .otherwise("under_forgetting")
    )
    return best.select("b.run", "b.forget_acc", label.alias("label"))


def audit_taxonomy(
    deltas: DataFrame, profile: DataFrame, near: float = 0.95,
    forget_gain: float = V.FORGET_GAIN, tolerance: float = V.RETAIN_TOLERANCE,
    collapse: float = V.COLLAPSE_RETAIN_DROP,
) -> DataFrame:
    """Joint label of behaviour change and representation change; thresholds are parameters."""
    geometry = profile.groupBy("run").agg(F.min("mean_cka").alias("cka"))
    same = F.col("delta_forget") >= -forget_gain
    kept = F.col("delta_retain") >= -tolerance
    label = (
        F.when(F.col("delta_retain") <= -collapse, "destructive_collapse")
        .when(same & kept & (F.col("cka") >= near), "under_forgetting")
        .when(same & kept, "hidden_drift")
        .when(kept, "candidate_partial_forgetting")
        .otherwise("unclassified")
    )
    return deltas.join(geometry, "run").select("run", "cka", label.alias("diagnosis"))


def control_gate(
    predictions: DataFrame, health: DataFrame | None = None,
    minimum: float = V.MIN_NAME_ACCURACY, maximum: float = V.MAX_CONTROL_ACCURACY,
) -> DataFrame:
    """Right with its own image, wrong with another or blank image, and actually trained."""

    def acc(mode: str, split: str) -> Column:
        return _rate(F.col("correct"), (F.col("mode") == mode) & _split(split))

    t = predictions.groupBy("run").agg(
        acc("correct", "forget").alias("forget_acc"),
        acc("correct", "retain").alias("retain_acc"),
        F.greatest(acc("mismatched", "forget"), acc("mismatched", "retain")).alias("mismatch_max"),
        F.greatest(acc("blank", "forget"), acc("blank", "retain")).alias("blank_max"),
    )
    if health is None:
        t = t.withColumn("trained", F.lit(True))
    else:
        t = t.join(health.select("run", "trained"), "run", "left")
    ok = (
        (F.col("forget_acc") >= minimum)
        & (F.col("retain_acc") >= minimum)
        & (F.col("mismatch_max") <= maximum)
        & (F.col("blank_max") <= maximum)
        & F.col("trained")
    )
    return t.select(
        "run", "forget_acc", "retain_acc", "mismatch_max", "blank_max",
        F.coalesce(ok, F.lit(False)).alias("pass"),
    )


def normalize_run_results(results: DataFrame) -> DataFrame:
    """Fill top-level metrics from nested ones, derive rates and deltas, list what is missing."""

    def opt(name: str) -> Column:
        return F.col(name) if name in results.columns else F.lit(None).cast("double")

    forget = F.coalesce(opt("forget_accuracy"), opt("forget_nested_accuracy"))
    retain = F.coalesce(opt("retain_accuracy"), opt("retain_nested_accuracy"))
    filled = results.withColumns(
        {
            "forget_accuracy": forget,
            "retain_accuracy": retain,
            "forget_rate": F.coalesce(opt("forget_rate"), F.lit(1.0) - forget),
            "delta_forget_accuracy": F.coalesce(
                opt("delta_forget_accuracy"), forget - opt("base_forget_accuracy")
            ),
            "delta_retain_accuracy": F.coalesce(
                opt("delta_retain_accuracy"), retain - opt("base_retain_accuracy")
            ),
        }
    )
    required = ["forget_accuracy", "forget_rate", "retain_accuracy"]
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull()
    )
    return filled.withColumn("missing_fields", F.array_join(missing, ",")).withColumn(
        "summary_complete", F.col("missing_fields") == ""
    )
