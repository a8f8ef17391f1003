"""Verdict roll-ups, integrity checks and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remnant.functions import text as T
from remnant.functions.common import ratio


def verdict_rollup(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per verdict; FAIL outranks WARN outranks PASS."""
    t = checks.groupBy(*(by or [])).agg(
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in ("PASS", "WARN", "FAIL")]
    )
    return t.withColumn(
        "overall",
        F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_warn") > 0, "WARN").otherwise("PASS"),
    )


def split_quality(items: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Items per split with a missing image, question or answer; ok when none and not empty."""

    def blank(c: str):
        return F.col(c).isNull() | (F.col(c) == "")

    rows = items
    if files is None:
        gone = blank("image")
    else:
        known = files.select(F.col("path").alias("image")).distinct().withColumn("_found", F.lit(True))
        rows = rows.join(known, "image", "left")
        gone = F.col("_found").isNull()
    t = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(gone).alias("missing_image"),
        F.count_if(blank("question")).alias("missing_question"),
        F.count_if(blank("answer")).alias("missing_answer"),
    )
    bad = F.col("missing_image") + F.col("missing_question") + F.col("missing_answer")
    return t.withColumn("ok", (F.col("n") > 0) & (bad == 0))


def preparation_report(
    identities: DataFrame, items: DataFrame, expected: dict[str, int] | None = None
) -> DataFrame:
    """Counts of records, items and identities, and of identities without image or questions.

    `identities` holds entity, has_image, has_qa.  `expected` maps count names to required
    values; the gate passes when all agree and no image is missing.
    """
    a = identities.agg(
        F.count(F.lit(1)).alias("source_records"),
        F.count_if(~F.col("has_image")).alias("n_no_image"),
        F.count_if(F.col("has_image") & ~F.col("has_qa")).alias("n_no_qa"),
    )
    b = items.agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("entity").alias("identities")
    )
    t = a.withColumns({c: b.select(c).scalar() for c in ("items", "identities")})
    ok = F.col("n_no_image") == 0
    for name, value in (expected or {}).items():
        ok = ok & (F.col(name) == value)
    return t.withColumn("gate", F.when(ok, "PASS").otherwise("FAIL"))


def identities_lacking(identities: DataFrame) -> DataFrame:
    """Identities without an image or without usable questions, one row each."""
    reason = F.when(~F.col("has_image"), "no_image").when(~F.col("has_qa"), "no_qa")
    return identities.select("entity", reason.alias("reason")).filter(F.col("reason").isNotNull())


def range_checks(
    table: DataFrame, columns: list[str], overlap: DataFrame | None = None, expected_spread: dict[str, float] | None = None,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Values in [0, 1]; overlap symmetric with unit diagonal; optional expected spreads.

    `table` may hold rates or CKA; without `overlap` only its own columns are checked.
    """

    def verdict(check: str, bad: DataFrame) -> DataFrame:
        return bad.select(
            F.lit(check).alias("check"),
            F.when(F.col("n_bad") == 0, "PASS").otherwise("FAIL").alias("verdict"),
            "n_bad",
        )

    def outside(c: str):
        return F.count_if((F.col(c) < 0) | (F.col(c) > 1))

    rates = table.agg(sum((outside(c) for c in columns), F.lit(0)).alias("n_bad"))
    out = verdict("rates in range", rates)
    if overlap is not None:
        value, diagonal = F.col("overlap"), F.col("run_a") == F.col("run_b")
        mirror = overlap.select(F.col("run_a").alias("run_b"), F.col("run_b").alias("run_a"), value.alias("m"))
        skewed = F.col("m").isNull() | (F.abs(value - F.col("m")) >= tolerance)
        # One pass: each check is a counter.
        counts = overlap.join(mirror, ["run_a", "run_b"], "left").agg(
            F.struct(
                outside("overlap").alias("overlap in range"), F.count_if(skewed).alias("overlap symmetric"),
                F.count_if(diagonal & (value != 1)).alias("overlap diagonal"),
            ).alias("c")
        ).select("c.*")
        names = counts.columns
        long = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("n_bad")) for n in names])).alias("e"))
        out = out.unionByName(long.select("e.check", F.when(F.col("e.n_bad") == 0, "PASS").otherwise("FAIL").alias("verdict"), "e.n_bad"))
    for column, spread in (expected_spread or {}).items():
        gap = F.abs(F.max(column) - F.min(column) - F.lit(float(spread)))
        out = out.unionByName(
            verdict(f"{column} spread", table.agg(F.when(gap < 1e-3, 0).otherwise(1).cast("bigint").alias("n_bad")))
        )
    return out


def coverage_of_runs(requested: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return requested.join(have.select(*keys), keys, "left_anti")


def id_coverage(needed: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """How many distinct needed ids the index holds."""
    want = needed.select(key).distinct()
    have = index.select(key).distinct().withColumn("_found", F.lit(True))
    t = want.join(have, key, "left").agg(
        F.count(F.lit(1)).alias("n_needed"), F.count("_found").alias("n_found")
    )
    return t.withColumn("pct", ratio(F.col("n_found") * 100, F.col("n_needed")))


def missing_ids(needed: DataFrame, index: DataFrame, key: str) -> DataFrame:
    return needed.select(key).distinct().join(index.select(key), key, "left_anti")


def top_sources(rows: DataFrame, k: int, source: str = "source_file") -> DataFrame:
    """The k sources with most records; names break ties."""
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), source).limit(k)
