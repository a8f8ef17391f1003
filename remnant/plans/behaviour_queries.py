"""Queries over predictions: alignment, accuracy, suppression, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from remnant.functions import fixed_values as V
from remnant.operators import alignment as J
from remnant.operators import behaviour as A
from remnant.operators import quality as G
from remnant.operators import selection as P
from remnant.plans import sql as S
from remnant.plans.registry import register
from remnant.plans.sql import r, with_
from remnant.plans.views import BASE_RUN, ORDER, Tables
from remnant.streaming.incremental import pending_runs

_P = with_(S.PREDICTIONS)
_LAST = with_(S.PREDICTIONS, S.LAST)
_AL = with_(S.PREDICTIONS, S.LAST, S.ALIGNED)
_B = with_(S.PREDICTIONS, S.BEHAVIOUR)
_D = with_(S.PREDICTIONS, S.BEHAVIOUR, S.DELTAS)


def _num(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _aligned(t: Tables):
    return J.align_runs(t.predictions(), BASE_RUN, ORDER)


def _table(t: Tables):
    return A.behaviour_table(t.predictions())


def _deltas(t: Tables):
    return A.behaviour_deltas(_table(t), BASE_RUN)


@register("s14_pending_runs", _P + """SELECT DISTINCT p.run FROM predictions p
WHERE NOT EXISTS (SELECT 1 FROM (SELECT run, count(*) AS n FROM predictions WHERE split = 'forget' GROUP BY run) d
  WHERE d.run = p.run AND d.n >= (SELECT avg(n) FROM (SELECT run, count(*) AS n FROM predictions WHERE split = 'forget' GROUP BY run)))""")
def s14(t: Tables):
    p = t.predictions()
    done = p.filter(F.col("split") == "forget").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    done = done.filter(F.col("n") >= done.agg(F.avg("n")).scalar())
    done = done.select("run", F.lit("v1").alias("scorer_version"), "n")
    wanted = p.select("run").distinct().withColumn("scorer_version", F.lit("v1"))
    return pending_runs(wanted, done, ["run", "scorer_version"]).select("run")


@register("s14_incomplete_runs", _P + """SELECT run FROM (SELECT run, count(*) AS n, count(*) FILTER (WHERE run <> 'view' OR NOT refusal) AS written FROM predictions GROUP BY run)
WHERE run = 'error' OR n <> written""")
def s14_rows(t: Tables):
    """One run has no result and one lacks the rows of refusals."""
    p = t.predictions()
    wanted = p.groupBy("run").agg(F.count(F.lit(1)).alias("n_expected"))
    written = p.filter((F.col("run") != "error") & ((F.col("run") != "view") | ~F.col("refusal")))
    return pending_runs(wanted, written.groupBy("run").agg(F.count(F.lit(1)).alias("n")), ["run"], "n_expected").select("run")


@register("p02_limit_items", _P + """SELECT run, split, item_key, event_id FROM predictions
QUALIFY row_number() OVER (PARTITION BY run, split ORDER BY ts, event_id) <= 25""")
def p02(t: Tables):
    return P.limit_items(t.predictions(), 25, ORDER, ["run", "split"]).select(
        "run", "split", "item_key", "event_id"
    )


@register("p02_limit_items_global", _P + """SELECT run, item_key, event_id FROM predictions ORDER BY ts, event_id LIMIT 100""")
def p02_global(t: Tables):
    return P.limit_items(t.predictions(), 100, ORDER).select("run", "item_key", "event_id")


@register("p10_hash_shuffle", _P + """SELECT run, event_id,
  row_number() OVER (PARTITION BY run ORDER BY md5('45|' || CAST(event_id AS VARCHAR)), event_id) - 1 AS pos FROM predictions""")
def p10(t: Tables):
    return P.hash_shuffle(t.predictions(), "event_id", 42, 3, ["run"]).select("run", "event_id", "pos")


@register("p10_cycled_steps", """WITH s AS (SELECT o_orderkey AS step, o_orderkey // n AS epoch, o_orderkey % n AS pos FROM orders, (SELECT count(*) AS n FROM part)),
o AS (SELECT epoch, p_partkey, row_number() OVER (PARTITION BY epoch ORDER BY md5(CAST(42 + epoch AS VARCHAR) || '|' || CAST(p_partkey AS VARCHAR)), p_partkey) - 1 AS pos
  FROM part, (SELECT DISTINCT epoch FROM s))
SELECT step, epoch, pos, p_partkey FROM s JOIN o USING (epoch, pos)""")
def p10_cycle(t: Tables):
    steps = t.table("orders").select(F.col("o_orderkey").alias("step"))
    return P.cycled_steps(steps, t.table("part"), "p_partkey", 42)


@register("j01_align_runs", _AL + "SELECT run, split, item_key, entity, base_correct, method_correct, base_response, method_response FROM aligned")
def j01(t: Tables):
    return _aligned(t)


@register("j01_item_keys", _P + """SELECT run, trim(entity) || '::' || trim(question) || '::' || trim(answer) AS item_key, count(*) AS n
FROM predictions GROUP BY 1, 2""")
def j01_keys(t: Tables):
    return t.predictions().groupBy("run", J.item_key().alias("item_key")).agg(F.count(F.lit(1)).alias("n"))


@register("j07_response_overlap", _LAST + f"""SELECT a.run AS run_a, b.run AS run_b, count(*) AS n, {r("avg(" + _num("a.response = b.response") + ")")} AS overlap
FROM last_pred a JOIN last_pred b USING (item_key) GROUP BY 1, 2""")
def j07(t: Tables):
    return J.response_overlap(J.last_per_item(t.predictions(), ORDER))


@register("a01_score_summary", _P + f"""SELECT run, attack, count(*) AS n, {r("avg(" + _num("correct") + ")")} AS correct_rate,
{r("avg(" + _num("refusal") + ")")} AS refusal_rate FROM predictions GROUP BY run, attack""")
def a01(t: Tables):
    return A.score_summary(t.predictions(), ["run", "attack"])


@register("a02_behaviour_table", _B + f"""SELECT run, {r("forget_acc")} AS forget_acc, {r("1 - forget_acc")} AS forget_rate,
{r("retain_acc")} AS retain_acc, forget_n, retain_n FROM behaviour""")
def a02(t: Tables):
    return _table(t)


def _attack(a: str) -> str:
    return f"avg(score) FILTER (WHERE attack = '{a}')"


@register("a03_attack_rates", _P + f"""SELECT run, {", ".join(r(_attack(a)) + " AS " + a for a in V.ATTACKS)},
count(DISTINCT item_key) AS n_items, {r("(" + " + ".join(_attack(a) for a in V.ATTACKS) + ") / 4")} AS mean_recovery
FROM predictions WHERE split = 'forget' GROUP BY run""")
def a03(t: Tables):
    return A.attack_rates(t.predictions().filter(F.col("split") == "forget"))


def _micro(a: str) -> str:
    hits = f"coalesce(sum(score) FILTER (WHERE attack = '{a}'), 0)"
    den = "count(*) FILTER (WHERE attack = 'rephrase')" if a == "rephrase" else "count(DISTINCT item_key)"
    return f"({hits} / ({den}))"


@register("a04_attack_rates_micro", _P + f"""SELECT run, {", ".join(r(_micro(a)) + " AS " + a for a in V.ATTACKS)},
count(DISTINCT item_key) AS n_items, {r("(" + " + ".join(_micro(a) for a in V.ATTACKS) + ") / 4")} AS mean_recovery
FROM predictions WHERE split = 'forget' GROUP BY run""")
def a04(t: Tables):
    return A.attack_rates(t.predictions().filter(F.col("split") == "forget"), micro=True)


RECOVERY = """last_item AS (SELECT run, entity, item_key FROM predictions
  QUALIFY row_number() OVER (PARTITION BY run, entity ORDER BY ts DESC, event_id DESC) = 1),
wide AS (SELECT run, entity, coalesce(avg(score) FILTER (WHERE attack = 'rephrase'), 0) AS rephrase,
    coalesce(avg(score) FILTER (WHERE attack = 'crop'), 0) AS crop,
    coalesce(avg(score) FILTER (WHERE attack = 'perturb'), 0) AS perturb
  FROM predictions JOIN last_item USING (run, entity, item_key) GROUP BY run, entity),
recovery AS (SELECT run, entity, a.attack, CASE a.attack WHEN 'rephrase' THEN rephrase WHEN 'crop' THEN crop ELSE perturb END AS score,
    (rephrase + crop + perturb) / 3 AS mean
  FROM wide, (SELECT unnest(['rephrase', 'crop', 'perturb']) AS attack) a)"""


@register("a05_entity_recovery", with_(S.PREDICTIONS, RECOVERY) + f"SELECT run, entity, attack, {r('score')} AS score, {r('mean')} AS mean FROM recovery")
def a05(t: Tables):
    return A.entity_recovery(t.predictions(), ORDER)


_CASES = " ".join(
    f"WHEN split = '{s}' AND {'' if b else 'NOT '}base_correct AND {'' if m else 'NOT '}method_correct THEN '{name}'"
    for s, cases in V.FLIP_CATEGORIES.items()
    for (b, m), name in cases.items()
)
_CATS = ", ".join(f"('{s}', '{n}')" for s, cases in V.FLIP_CATEGORIES.items() for n in cases.values())


@register("a06_flip_counts", _AL + f"""SELECT g.run, g.split, c.category, count(f.run) AS n
FROM (SELECT DISTINCT run, split FROM aligned) g JOIN (VALUES {_CATS}) c(split, category) ON c.split = g.split
LEFT JOIN (SELECT run, split, CASE {_CASES} END AS category FROM aligned) f
  ON f.run = g.run AND f.split = g.split AND f.category = c.category GROUP BY 1, 2, 3""")
def a06(t: Tables):
    return A.flip_counts(_aligned(t))


@register("a07_suppressed_items", _AL + """SELECT run, count(*) FILTER (WHERE hit) AS n_suppressed
FROM (SELECT *, split = 'forget' AND base_correct AND NOT method_correct AS hit FROM aligned) GROUP BY run""")
def a07(t: Tables):
    return A.suppressed_items(_aligned(t))


@register("a07_suppressed_rows", _AL + "SELECT run, item_key FROM aligned WHERE split = 'forget' AND base_correct AND NOT method_correct")
def a07_rows(t: Tables):
    return A.suppressed_rows(_aligned(t))


@register("a08_recovered_of_suppressed", _AL + """SELECT a.run, count(*) FILTER (WHERE hit) AS n_suppressed,
count(*) FILTER (WHERE hit AND coalesce(x.ok, false)) AS n_recovered
FROM (SELECT *, split = 'forget' AND base_correct AND NOT method_correct AS hit FROM aligned) a
LEFT JOIN (SELECT run, item_key, bool_or(correct) AS ok FROM predictions WHERE attack = 'rephrase' GROUP BY 1, 2) x
  ON x.run = a.run AND x.item_key = a.item_key GROUP BY a.run""")
def a08(t: Tables):
    return A.recovered_of_suppressed(_aligned(t), t.predictions().filter(F.col("attack") == "rephrase"))


@register("a09_prompt_occurrence", _P + f"""SELECT run, split, occurrence, count(*) AS n, count(*) FILTER (WHERE correct) AS correct,
{r("avg(score)")} AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY run, split, entity ORDER BY ts, event_id) AS occurrence
FROM predictions) GROUP BY 1, 2, 3""")
def a09(t: Tables):
    return A.prompt_occurrence(t.predictions(), ORDER)


@register("a10_behaviour_deltas", _D + f"SELECT run, {r('delta_forget')} AS delta_forget, {r('delta_retain')} AS delta_retain FROM deltas")
def a10(t: Tables):
    return _deltas(t).select("run", "delta_forget", "delta_retain")


_REGIME = """CASE WHEN delta_retain <= -0.2 THEN 'COLLAPSE_OR_SEVERE_UTILITY_DAMAGE'
 WHEN delta_forget < 0 AND delta_retain >= -0.05 THEN 'DIRECTIONAL_SELECTIVE_FORGETTING'
 WHEN abs(delta_forget) < 1e-12 AND delta_retain >= -0.05 THEN 'UNDER_FORGETTING'
 WHEN delta_forget < 0 THEN 'FORGETTING_WITH_UTILITY_DAMAGE'
 WHEN delta_forget > 0 THEN 'UNEXPECTED_RECOVERY_OR_RELEARNING' ELSE 'NO_CLEAR_SELECTIVE_EFFECT' END"""


@register("a11_regime", _D + f"""SELECT run, regime, CASE WHEN regime = 'DIRECTIONAL_SELECTIVE_FORGETTING' THEN 'PASS' ELSE 'WARN' END AS verdict
FROM (SELECT run, {_REGIME} AS regime FROM deltas)""")
def a11(t: Tables):
    return A.regime(_deltas(t))


@register("a12_sweep_verdict", _D[:-1] + f""", collapse AS (SELECT run, bool_or(f > 0.5) AS collapsed FROM
 (SELECT run, split, avg({_num("collapsed")}) AS f FROM predictions GROUP BY 1, 2) GROUP BY run)
SELECT d.run, CASE WHEN collapsed OR delta_retain < -0.05 THEN 'FAIL' WHEN delta_forget < -0.01 THEN 'PASS' ELSE 'WARN' END AS verdict,
 CASE WHEN collapsed THEN 'generation collapse detected' WHEN delta_retain < -0.05 THEN 'retain accuracy below tolerance'
  WHEN delta_forget < -0.01 THEN 'forget accuracy improved while retain utility was preserved'
  ELSE 'no meaningful forget-accuracy improvement' END AS reason FROM deltas d JOIN collapse USING (run)""")
def a12(t: Tables):
    return A.sweep_verdict(_deltas(t), A.collapse_by_run(t.predictions()))


@register("a13_best_config", _B + f"""SELECT run, {r("forget_acc")} AS forget_acc,
CASE WHEN forget_acc < 0.5 AND retain_acc > 0.8 THEN 'selective' WHEN forget_acc < 0.5 THEN 'retain_damaged' ELSE 'under_forgetting' END AS label
FROM behaviour ORDER BY behaviour.forget_acc, run LIMIT 1""")
def a13(t: Tables):
    return A.best_config(_table(t))


def _acc(mode: str, split: str) -> str:
    return f"avg(score) FILTER (WHERE mode = '{mode}' AND split = '{split}')"


@register("a15_control_gate", _P + f"""SELECT run, {r("fa")} AS forget_acc, {r("ra")} AS retain_acc, {r("mm")} AS mismatch_max, {r("bm")} AS blank_max,
fa >= 0.6 AND ra >= 0.6 AND mm <= 0.3 AND bm <= 0.3 AS pass FROM (SELECT run, {_acc("correct", "forget")} AS fa, {_acc("correct", "retain")} AS ra,
greatest({_acc("mismatched", "forget")}, {_acc("mismatched", "retain")}) AS mm, greatest({_acc("blank", "forget")}, {_acc("blank", "retain")}) AS bm
FROM predictions GROUP BY run)""")
def a15(t: Tables):
    return A.control_gate(t.predictions())


@register("a16_normalize_run_results", f"""SELECT label, {r("fa")} AS forget_accuracy, {r("ra")} AS retain_accuracy, {r("1 - fa")} AS forget_rate,
{r("fa - 0.5")} AS delta_forget_accuracy, {r("ra - 0.5")} AS delta_retain_accuracy,
concat_ws(',', CASE WHEN fa IS NULL THEN 'forget_accuracy' END, CASE WHEN fa IS NULL THEN 'forget_rate' END, CASE WHEN ra IS NULL THEN 'retain_accuracy' END) AS missing_fields,
fa IS NOT NULL AND ra IS NOT NULL AS summary_complete
FROM (SELECT o_orderkey AS label, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 500000 WHEN o_orderkey % 2 = 0 THEN o_totalprice / 1000000 END AS fa,
  CASE WHEN o_orderkey % 7 <> 0 THEN 1 - o_totalprice / 500000 END AS ra FROM orders)""")
def a16(t: Tables):
    k, x = F.col("o_orderkey"), F.col("o_totalprice")
    rows = t.table("orders").select(
        k.alias("label"),
        F.when(k % 5 != 0, x / 500000).alias("forget_accuracy"),
        F.when(k % 2 == 0, x / 1000000).alias("forget_nested_accuracy"),
        F.lit(None).cast("double").alias("retain_accuracy"),
        F.when(k % 7 != 0, 1 - x / 500000).alias("retain_nested_accuracy"),
        F.lit(0.5).alias("base_forget_accuracy"),
        F.lit(0.5).alias("base_retain_accuracy"),
    )
    return A.normalize_run_results(rows).select(
        "label", "forget_accuracy", "retain_accuracy", "forget_rate", "delta_forget_accuracy",
        "delta_retain_accuracy", "missing_fields", "summary_complete",
    )


@register("g07_verdict_rollup", """SELECT o_custkey AS "group", count(*) FILTER (WHERE o_orderstatus = 'P') AS n_pass,
count(*) FILTER (WHERE o_orderstatus = 'O') AS n_warn, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_fail,
CASE WHEN bool_or(o_orderstatus = 'F') THEN 'FAIL' WHEN bool_or(o_orderstatus = 'O') THEN 'WARN' ELSE 'PASS' END AS overall
FROM orders GROUP BY o_custkey""")
def g07(t: Tables):
    return G.verdict_rollup(t.checks(), ["group"])


@register("g10_range_checks", _LAST + f""", b AS (SELECT run, avg(score) FILTER (WHERE split = 'forget') AS fa, avg(score) FILTER (WHERE split = 'retain') AS ra FROM predictions GROUP BY run),
o AS (SELECT a.run AS run_a, b.run AS run_b, avg({_num("a.response = b.response")}) AS v FROM last_pred a JOIN last_pred b USING (item_key) GROUP BY 1, 2)
SELECT * FROM (
SELECT 'rates in range' AS "check", CASE WHEN count(*) FILTER (WHERE fa < 0 OR fa > 1 OR ra < 0 OR ra > 1) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) FILTER (WHERE fa < 0 OR fa > 1) + count(*) FILTER (WHERE ra < 0 OR ra > 1) AS n_bad FROM b
UNION ALL SELECT 'overlap in range', CASE WHEN count(*) FILTER (WHERE v < 0 OR v > 1) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FILTER (WHERE v < 0 OR v > 1) FROM o
UNION ALL SELECT 'overlap symmetric', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM o x LEFT JOIN o y ON x.run_a = y.run_b AND x.run_b = y.run_a WHERE y.v IS NULL OR abs(x.v - y.v) >= 1e-9
UNION ALL SELECT 'overlap diagonal', CASE WHEN count(*) FILTER (WHERE v <> 1) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FILTER (WHERE v <> 1) FROM o WHERE run_a = run_b)""".replace("WITH", "WITH", 1))
def g10(t: Tables):
    overlap = J.response_overlap(J.last_per_item(t.predictions(), ORDER))
    return G.range_checks(_table(t), ["forget_acc", "retain_acc"], overlap)


@register("g11_attacks_of_entities", _P + """SELECT run, entity, attack FROM (SELECT DISTINCT run, entity FROM predictions), (SELECT unnest(['direct', 'rephrase', 'crop', 'perturb']) AS attack)
EXCEPT SELECT run, entity, attack FROM predictions""")
def g11_entities(t: Tables):
    """Attacks that no prediction of a run made on an entity."""
    p = t.predictions()
    attacks = F.array(*[F.lit(a) for a in V.ATTACKS])
    wanted = p.select("run", "entity").distinct().select("run", "entity", F.explode(attacks).alias("attack"))
    return G.coverage_of_runs(wanted, p, ["run", "entity", "attack"])


@register("g11_coverage_of_runs", _P + """SELECT run, attack FROM (SELECT DISTINCT run FROM predictions), (SELECT DISTINCT attack FROM predictions)
WHERE (run, attack) NOT IN (SELECT run, attack FROM predictions WHERE split = 'forget' AND refusal)""")
def g11(t: Tables):
    p = t.predictions()
    attacks = F.array(*[F.lit(a) for a in V.ATTACKS])
    wanted = p.select("run").distinct().select("run", F.explode(attacks).alias("attack"))
    have = p.filter((F.col("split") == "forget") & F.col("refusal")).select("run", "attack")
    return G.coverage_of_runs(wanted, have, ["run", "attack"])
