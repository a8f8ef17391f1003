"""Queries over activations, weights and replicates: CKA, RSA, bootstraps, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from remnant.functions import fixed_values as V
from remnant.functions import text as T
from remnant.functions.common import hash_key
from remnant.operators import alignment as J
from remnant.operators import behaviour as A
from remnant.operators import bootstrap as B
from remnant.operators import pairwise as W
from remnant.operators import quality as Q
from remnant.operators import similarity as C
from remnant.operators import stats as K
from remnant.operators.wide import tiled_cka
from remnant.plans import sql as S
from remnant.plans.behaviour_queries import RECOVERY
from remnant.plans.registry import register
from remnant.plans.sql import r, with_
from remnant.plans.views import BASE_RUN, ORDER, Tables

G = "run, component, layer"
_PAIRS = (S.ACTIVATIONS, S.PAIRS)


def cka_ctes(source: str, by: str, prefix: str = "", weight: str = "1.0::DOUBLE") -> list[str]:
    """CTEs for feature-space CKA of `source` (by, item_id, x, y, optional weight)."""
    on = f"USING ({by})"
    p = prefix
    return [
        f"{p}u AS (SELECT {by}, item_id, {weight} AS w, generate_subscripts(x, 1) AS j, unnest(x) AS x, unnest(y) AS y FROM {source})",
        f"{p}m AS (SELECT {by}, j, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM {p}u GROUP BY {by}, j)",
        f"{p}c AS (SELECT {by}, item_id, w, j, x - mx AS x, y - my AS y FROM {p}u JOIN {p}m USING ({by}, j))",
        f"{p}crs AS (SELECT {by}, a.j AS i, b.j AS j, sum(a.w * a.x * b.x) AS xx, sum(a.w * a.x * b.y) AS xy, sum(a.w * a.y * b.y) AS yy FROM {p}c a JOIN {p}c b USING ({by}, item_id) GROUP BY {by}, a.j, b.j)",
        f"{p}fro AS (SELECT {by}, sum(xx * xx) AS fxx, sum(xy * xy) AS fxy, sum(yy * yy) AS fyy FROM {p}crs GROUP BY {by})",
        f"{p}norms AS (SELECT {by}, item_id, any_value(w) AS w, sum(x * x) AS k, sum(y * y) AS l FROM {p}c GROUP BY {by}, item_id)",
        f"{p}tot AS (SELECT {by}, sum(w) AS n, sum(w * k) AS k, sum(w * l) AS l, sum(w * k * l) AS kl, sum(w * k * k) AS kk, sum(w * l * l) AS ll FROM {p}norms GROUP BY {by})",
        f"""{p}hsic AS (SELECT {by}, n, fxx, fxy, fyy,
  (fxy - kl - 2 * kl / (n - 2) + k * l / ((n - 1) * (n - 2))) / (n * (n - 3)) AS hxy,
  (fxx - kk - 2 * kk / (n - 2) + k * k / ((n - 1) * (n - 2))) / (n * (n - 3)) AS hxx,
  (fyy - ll - 2 * ll / (n - 2) + l * l / ((n - 1) * (n - 2))) / (n * (n - 3)) AS hyy FROM {p}tot JOIN {p}fro {on} WHERE n >= 4)""",
        f"""{p}cka AS (SELECT {by}, CAST(n AS BIGINT) AS n, CASE WHEN hxx > 0 AND hyy > 0 THEN least(1.0, greatest(0.0, hxy / sqrt(greatest(hxx * hyy, 1e-10)))) END AS cka,
  CASE WHEN fxx * fyy > 0 THEN least(1.0, greatest(0.0, fxy / sqrt(fxx * fyy))) ELSE 0.0 END AS biased FROM {p}hsic)""",
    ]


_CKA = with_(*_PAIRS, *cka_ctes("pairs", G))


@register("s09_read_activations", with_(*_PAIRS) + f"SELECT {G}, item_id, entity, {r('list_sum(x)')} AS sum_x, {r('list_sum(y)')} AS sum_y FROM pairs")
def s09(t: Tables):
    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)

    return t.pairs().select("run", "component", "layer", "item_id", "entity", total("x").alias("sum_x"), total("y").alias("sum_y"))


@register("j08_align_activations", with_(*_PAIRS) + f"SELECT {G}, split, count(*) AS n FROM pairs WHERE ({G.replace(', ', ', ')}) IN (SELECT ({G}) FROM pairs GROUP BY {G} HAVING count(*) >= 4) GROUP BY {G}, split")
def j08(t: Tables):
    return C.align_activations(t.activations(), 0, 4).groupBy("run", "component", "layer", "split").agg(F.count(F.lit(1)).alias("n"))


@register("c01_linear_cka_biased", _CKA + f"SELECT {G}, n, {r('biased')} AS cka FROM cka")
def c01(t: Tables):
    return C.cka(t.pairs(), kind="biased")


@register("c02_linear_cka_debiased", _CKA + f"SELECT {G}, n, {r('cka')} AS cka FROM cka")
def c02(t: Tables):
    return C.cka(t.pairs())


@register("c02_linear_cka_tiled", _CKA + f"SELECT {G}, n, {r('cka')} AS cka FROM cka")
def c02_tiled(t: Tables):
    """The same through column tiles, which do not fit the width, and blocks of few rows."""
    return tiled_cka(t.pairs(), C.PROFILE, tile=3, block_bytes=1 << 14).select(*C.PROFILE, "n", F.col("debiased").alias("cka")).filter("n >= 4")


_DIST = """dist AS (SELECT run, component, layer, a.item_id AS i, b.item_id AS j,
  list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dx, list_sum(list_transform(list_zip(a.y, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dy
  FROM pairs a JOIN pairs b USING (run, component, layer))"""


@register("c03_rbf_cka", with_(*_PAIRS, _DIST, f"sig AS (SELECT {G}, sqrt(quantile_disc(dx, 0.5)) + 1e-8 AS sx, sqrt(quantile_disc(dy, 0.5)) + 1e-8 AS sy FROM dist GROUP BY {G})",
    f"kern AS (SELECT {G}, i, j, exp(-dx / (2 * sx * sx)) AS kx, exp(-dy / (2 * sy * sy)) AS ky FROM dist JOIN sig USING ({G}))",
    f"rowsum AS (SELECT {G}, i, sum(kx) AS rx, sum(ky) AS ry FROM kern GROUP BY {G}, i)",
    f"agg AS (SELECT {G}, count(*) AS n, sum(rx) AS tx, sum(ry) AS ty, sum(rx * ry) AS rxy, sum(rx * rx) AS rxx, sum(ry * ry) AS ryy FROM rowsum GROUP BY {G})",
    f"sums AS (SELECT {G}, sum(kx * ky) AS xy, sum(kx * kx) AS xx, sum(ky * ky) AS yy FROM kern GROUP BY {G})") + f"""
SELECT {G}, n, {r("least(1, greatest(0, (xy - 2 * rxy / n + tx * ty / (n * n)) / sqrt((xx - 2 * rxx / n + tx * tx / (n * n)) * (yy - 2 * ryy / n + ty * ty / (n * n)))))")} AS cka FROM agg JOIN sums USING ({G})""")
def c03(t: Tables):
    return W.rbf_cka(t.pairs())


def _entity_means() -> str:
    return f"""em AS (SELECT {G}, item_id, list(x ORDER BY j) AS x, list(y ORDER BY j) AS y FROM (SELECT {G}, entity AS item_id, j, avg(x) AS x, avg(y) AS y
  FROM (SELECT {G}, entity, generate_subscripts(x, 1) AS j, unnest(x) AS x, unnest(y) AS y FROM pairs) GROUP BY {G}, entity, j) GROUP BY {G}, item_id)"""


def _rdm_sql(dx: str) -> str:
    return f"rdm AS (SELECT {G}, a.item_id AS i, b.item_id AS j, {dx.format(v='x')} AS d_x, {dx.format(v='y')} AS d_y FROM em a JOIN em b USING ({G}) WHERE a.item_id < b.item_id)"


_COS = "greatest(0.0, 1 - list_sum(list_transform(list_zip(a.{v}, b.{v}), lambda z: z[1] * z[2])) / ((sqrt(list_sum(list_transform(a.{v}, lambda q: q * q))) + 1e-8) * (sqrt(list_sum(list_transform(b.{v}, lambda q: q * q))) + 1e-8)))"
_EUC = "sqrt(list_sum(list_transform(list_zip(a.{v}, b.{v}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_CEN = "list_transform({s}.{v}, lambda q: q - list_avg({s}.{v}))"
_COR = ("greatest(0.0, 1 - list_sum(list_transform(list_zip(" + _CEN.replace("{s}", "a") + ", " + _CEN.replace("{s}", "b") + "), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform("
        + _CEN.replace("{s}", "a") + ", lambda q: q * q))) * sqrt(list_sum(list_transform(" + _CEN.replace("{s}", "b") + ", lambda q: q * q)))))")


def _register_rdm(name: str, metric: str, sql: str):
    @register(name, with_(*_PAIRS, _entity_means(), _rdm_sql(sql)) + f"SELECT {G}, i, j, {r('d_x')} AS d_x, {r('d_y')} AS d_y FROM rdm")
    def query(t: Tables):
        return W.rdm(W.entity_means(t.pairs()), metric)


_register_rdm("c04_rdm_cosine", "cosine", _COS)
_register_rdm("c04_rdm_euclidean", "euclidean", _EUC)
_register_rdm("c04_rdm_correlation", "correlation", _COR)

_RANKED = """rk AS (SELECT {g}, rank() OVER (PARTITION BY {g} ORDER BY a) + (count(*) OVER (PARTITION BY {g}, a) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY {g} ORDER BY b) + (count(*) OVER (PARTITION BY {g}, b) - 1) / 2.0 AS rb, a, b FROM {s})"""


@register("c05_rsa", with_(*_PAIRS, _entity_means(), _rdm_sql(_COS), _RANKED.format(g=G, s=f"(SELECT {G}, round(d_x, 12) AS a, round(d_y, 12) AS b FROM rdm)"))
          + f"SELECT {G}, count(*) AS n, {r('corr(ra, rb)')} AS rho FROM rk GROUP BY {G}")
def c05(t: Tables):
    return W.rsa(W.entity_means(t.pairs()), p_values=False)


@register("c05_rsa_p_values", with_(*_PAIRS, _entity_means(), _rdm_sql(_COS), _RANKED.format(g=G, s=f"(SELECT {G}, round(d_x, 12) AS a, round(d_y, 12) AS b FROM rdm)"), f"rho AS (SELECT {G}, count(*) AS n, corr(ra, rb) AS rho FROM rk GROUP BY {G})")
          + f"SELECT {G}, n, {r('rho')} AS rho, {r(S.p_value('rho', 'n'))} AS p FROM rho")
def c05_p(t: Tables):
    return W.rsa(W.entity_means(t.pairs()))


_ITEMS = "em AS (SELECT run, component, layer, item_id, x, y FROM pairs)"


@register("c05_rsa_of_items", with_(*_PAIRS, _ITEMS, _rdm_sql(_COS), _RANKED.format(g=G, s=f"(SELECT {G}, round(d_x, 12) AS a, round(d_y, 12) AS b FROM rdm)"))
          + f"SELECT {G}, count(*) AS n, {r('corr(ra, rb)')} AS rho FROM rk GROUP BY {G}")
def c05_items(t: Tables):
    return W.rsa_of_items(t.pairs()).drop("p")


@register("c06_component_profile", _CKA + f"SELECT {G}, n, {r('cka')} AS cka FROM cka")
def c06(t: Tables):
    return C.component_profile(t.pairs())


@register("c07_component_summary", _CKA + f"SELECT run, component, {r('avg(cka)')} AS mean_cka, count(cka) AS n_layers FROM cka GROUP BY run, component")
def c07(t: Tables):
    return C.component_summary(C.component_profile(t.pairs()))


POOLED = """pooled AS (SELECT run, component, 0 AS layer, item_id, entity, split, list(v ORDER BY j) AS vec FROM (SELECT run, component, item_id, entity, split, j, avg(v) AS v
  FROM (SELECT run, component, item_id, entity, split, generate_subscripts(vec, 1) AS j, unnest(vec) AS v FROM act) GROUP BY ALL) GROUP BY run, component, item_id, entity, split),
pooled_pairs AS (SELECT y.run, y.component, y.item_id, x.vec AS x, y.vec AS y FROM pooled y JOIN pooled x USING (component, item_id) WHERE x.run = 0 AND y.run <> 0)"""


@register("c08_layer_pooling", with_(S.ACTIVATIONS, POOLED, *cka_ctes("pooled_pairs", "run, component")) + f"SELECT run, component, n, {r('cka')} AS cka FROM cka")
def c08(t: Tables):
    pooled = C.layer_pooling(t.activations())
    return C.cka(C.align_activations(pooled, 0), ["run", "component"])


def _token_rows(t: Tables):
    """The layers of a component play the part of token positions."""
    return t.activations().withColumnRenamed("layer", "pos")


_KEYS = ["run", "component", "item_id", "entity", "split"]


def _register_pool(mode: str, sql: str):
    @register(f"c09_token_pooling_{mode}", with_(S.ACTIVATIONS) + sql)
    def query(t: Tables):
        v = C.token_pooling(_token_rows(t), mode, _KEYS)
        return v.select("run", "component", "item_id", F.posexplode("vec").alias("unit", "value"))


def _units(where: str) -> str:
    return f"(SELECT run, component, item_id, generate_subscripts(vec, 1) - 1 AS unit, unnest(vec) AS v FROM act {where})"


_register_pool("mean", f"SELECT run, component, item_id, unit, {r('avg(v)')} AS value FROM {_units('')} GROUP BY ALL")
_register_pool("first", f"SELECT run, component, item_id, unit, {r('v')} AS value FROM {_units('WHERE layer = 0')}")
_register_pool("last", f"SELECT run, component, item_id, unit, {r('v')} AS value FROM {_units('WHERE layer = 2')}")


@register("c10_pooling_sensitivity", with_(S.ACTIVATIONS, S.PAIRS, *cka_ctes("(SELECT * FROM pairs WHERE layer = 2)", "run, component", "l"), POOLED, *cka_ctes("pooled_pairs", "run, component", "q"))
          + f"SELECT run, component, {r('abs(a.cka - b.cka)')} AS abs_diff FROM qcka a JOIN lcka b USING (run, component)")
def c10(t: Tables):
    tokens = _token_rows(t)

    def summary(mode: str):
        vecs = C.token_pooling(tokens, mode, _KEYS).withColumn("layer", F.lit(0))
        return C.component_summary(C.cka(C.align_activations(vecs, 0)))

    return C.pooling_sensitivity(summary("mean"), summary("last"))


@register("c11_layer_profile", _CKA + f"SELECT run, component, layer, {r('cka')} AS cka, {r('avg(cka) OVER (PARTITION BY run, component)')} AS aggregate FROM cka")
def c11(t: Tables):
    return C.layer_profile(C.component_profile(t.pairs()))


@register("c12_selectivity", with_(*_PAIRS, *cka_ctes("pairs", G + ", split")) + f"""SELECT run, component, {r("avg(cka) FILTER (WHERE split = 'forget')")} AS forget_cka,
{r("avg(cka) FILTER (WHERE split = 'retain')")} AS retain_cka, {r("avg(cka) FILTER (WHERE split = 'retain') - avg(cka) FILTER (WHERE split = 'forget')")} AS diff FROM cka GROUP BY run, component""")
def c12(t: Tables):
    return C.selectivity(C.cka(t.pairs(), [*C.PROFILE, "split"]))


RESIDUAL = """resid AS (SELECT run, component, entity, least(1.0, greatest(-1.0, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))))) AS sim
  FROM (SELECT run, component, entity, j, avg(x) AS x, avg(y) AS y FROM (SELECT run, component, entity, generate_subscripts(x, 1) AS j, unnest(x) AS x, unnest(y) AS y FROM pairs WHERE layer = 2)
  GROUP BY run, component, entity, j) GROUP BY run, component, entity)"""
_RES = with_(*_PAIRS, RESIDUAL)


@register("c13_entity_residual", _RES + f"SELECT run, component, entity, {r('sim')} AS sim FROM resid")
def c13(t: Tables):
    return C.entity_residual(t.pairs())


@register("c14_matrix_health", with_(S.ACTIVATIONS) + f"""SELECT {G}, count(*) AS n, min(len(vec)) AS dim_min, max(len(vec)) AS dim_max, count(*) FILTER (WHERE len(list_filter(vec, lambda v: isnan(v))) > 0) AS n_nan,
{r("max(list_max(list_transform(vec, lambda v: abs(v))))")} AS max_abs,
CASE WHEN min(len(vec)) <> max(len(vec)) OR count(*) FILTER (WHERE len(list_filter(vec, lambda v: isnan(v))) > 0) > 0 THEN 'FAIL'
 WHEN max(list_max(list_transform(vec, lambda v: abs(v)))) < 1e-10 THEN 'WARN' ELSE 'PASS' END AS verdict FROM act GROUP BY {G}""")
def c14(t: Tables):
    return C.matrix_health(t.activations())


@register("c15_influence_loeo", with_(*_PAIRS, *cka_ctes("pairs", G, "f"), "ents AS (SELECT DISTINCT entity AS gone FROM pairs)",
    "loo AS (SELECT run, component, layer, gone, item_id, x, y FROM pairs JOIN ents ON entity <> gone)", *cka_ctes("loo", G + ", gone", "o"))
    + f"SELECT {G}, gone AS entity, {r('o.cka')} AS cka_without, {r('o.cka - f.cka')} AS influence FROM ocka o JOIN fcka f USING ({G})")
def c15(t: Tables):
    return C.influence_loeo(t.pairs())


@register("c16_entity_disjoint_probe")
def c16(t: Tables):
    return C.entity_disjoint_probe(t.activations().withColumn("is_forget", (F.col("split") == "forget").cast("double")), "is_forget")


@register("c16_logistic_probe")
def c16_logistic(t: Tables):
    """Coefficients are tested against another solver; the unit vectors of a fold are judged by them."""
    acts = t.activations().withColumn("is_forget", (F.col("split") == "forget").cast("double"))
    return C.logistic_probe(acts, "is_forget").drop("weights")


@register("c17_discriminative_units", with_(S.ACTIVATIONS) + f"""SELECT run, component, layer, unit, {r('score')} AS score, rank FROM (SELECT run, component, layer, j - 1 AS unit, abs(s) AS score,
 row_number() OVER (PARTITION BY run, component, layer ORDER BY abs(s) DESC, j) AS rank FROM (SELECT run, component, layer, j, sum(CASE WHEN split = 'forget' THEN v ELSE -v END) AS s
 FROM (SELECT run, component, layer, split, generate_subscripts(vec, 1) AS j, unnest(vec) AS v FROM act) GROUP BY run, component, layer, j)) WHERE rank <= greatest(1, floor(8 * 0.3))""")
def c17(t: Tables):
    return C.discriminative_units(t.activations(), 0.3, tuple(C.PROFILE))


_W = """w AS (SELECT label AS checkpoint, 'lora_B.' || CAST(vec_id AS VARCHAR) AS tensor, list_transform(embedding, lambda v: CASE WHEN vec_id % 5 = 0 THEN 0.0::DOUBLE ELSE CAST(v AS DOUBLE) END) AS vals FROM embeddings)"""


@register("c18_weight_health", with_(_W) + f"""SELECT checkpoint, count(*) AS total, count(*) FILTER (WHERE m > 1e-8) AS nonzero, bool_and(ok) AS finite, {r('max(m)')} AS max_abs,
CASE WHEN count(*) FILTER (WHERE m > 1e-8) > 0 AND bool_and(ok) THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM (SELECT checkpoint, ok, CASE WHEN ok THEN list_max(list_transform(vals, lambda v: abs(v))) END AS m FROM (SELECT *, len(list_filter(vals, lambda v: NOT isfinite(v))) = 0 AS ok FROM w)) GROUP BY checkpoint""")
def c18(t: Tables):
    return C.weight_health(t.weights(), V.WEIGHT_ATOL)


@register("c19_weight_drift", with_(_W) + f"""SELECT checkpoint, {r("sum(list_sum(list_transform(vals, lambda v: (v - v * 0.9) * (v - v * 0.9)))) / (sum(len(vals)) + 1e-8)")} AS drift FROM w
WHERE contains(tensor, 'lora_B.1') GROUP BY checkpoint""")
def c19(t: Tables):
    w = t.weights()
    old = w.select("tensor", F.transform("values", lambda v: v * F.lit(0.9)).alias("values"))
    return C.weight_drift(w, old, ["lora_B.1"])


# -- statistics ------------------------------------------------------------------------
def value_pairs(t: Tables):
    k = F.get_json_object("props", "$.k").cast("double")
    return t.table("events").select(
        F.col("event_type").alias("run"), F.col("value").alias("x"), (k + F.col("user_id") % 10).alias("y"), F.col("user_id").cast("string").alias("entity")
    )


VALUES = "vals AS (SELECT event_type AS run, value AS a, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) + user_id % 10 AS b, CAST(user_id AS VARCHAR) AS entity FROM events)"


@register("k01_pearson", with_(VALUES) + f"SELECT run, count(*) AS n, {r('corr(a, b)')} AS pearson_r FROM vals GROUP BY run")
def k01(t: Tables):
    return K.pearson(value_pairs(t), "x", "y", ["run"]).drop("pearson_p")


@register("k01_pearson_p_value", with_(VALUES, "cor AS (SELECT run, count(*) AS n, corr(a, b) AS c FROM vals GROUP BY run)") + f"SELECT run, n, {r('c')} AS pearson_r, {r(S.p_value('c', 'n'))} AS pearson_p FROM cor")
def k01_p(t: Tables):
    return K.pearson(value_pairs(t), "x", "y", ["run"])


@register("k02_spearman", with_(VALUES, _RANKED.format(g="run", s="vals")) + f"SELECT run, count(*) AS n, {r('corr(a, b)')} AS pearson_r, {r('corr(ra, rb)')} AS spearman_r, CASE WHEN count(*) < 3 THEN 'insufficient data' WHEN count(DISTINCT round(a, 8)) < 2 OR count(DISTINCT round(b, 8)) < 2 THEN 'constant input' ELSE 'ok' END AS status FROM rk GROUP BY run")
def k02(t: Tables):
    return K.correlate(value_pairs(t), "x", "y", ["run"], p_values=False)


@register("k03_correlation_guard", with_(VALUES) + """SELECT entity, count(*) AS n, CASE WHEN count(*) < 3 THEN 'insufficient data'
WHEN count(DISTINCT round(a, 8)) < 2 OR count(DISTINCT round(c, 8)) < 2 THEN 'constant input' ELSE 'ok' END AS status
FROM (SELECT entity, a, CASE WHEN CAST(entity AS BIGINT) % 4 = 0 THEN 1.0 ELSE b END AS c FROM vals) GROUP BY entity""")
def k03(t: Tables):
    constant = F.when(F.col("entity").cast("bigint") % 4 == 0, 1.0).otherwise(F.col("y"))
    return K.correlation_guard(value_pairs(t).withColumn("y", constant), "x", "y", ["entity"])


PROFILE_RUNS = {"signup": 0, "click": 1, "view": 2, "purchase": 3, "error": 4}
_RUN_CASE = "CASE run " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PROFILE_RUNS.items()) + " END"


def _run_number():
    out = F.lit(None).cast("int")
    for name, number in PROFILE_RUNS.items():
        out = F.when(F.col("run") == name, number).otherwise(out)
    return out


def _recovery(t: Tables):
    """Recovery of every user in every run that also has activations; entities are named run:user."""
    rows = A.entity_recovery(t.predictions(), ORDER).withColumn("run", _run_number()).filter(F.col("run").isNotNull())
    return rows.select(F.concat_ws(":", F.col("run").cast("string"), "entity").alias("entity"), "attack", "score")


def _residuals(t: Tables):
    """Residual of every run, for each user: that of the entity of activations which ends like the user's number."""
    users = t.predictions().select(F.col("entity").alias("user")).distinct()
    means = C.entity_residual(t.pairs()).join(users, (F.col("user").cast("bigint") % 10) == F.col("entity"))
    return means.select(F.concat_ws(":", F.col("run").cast("string"), "user").alias("entity"), "component", "sim")


_GRID = with_(*_PAIRS, RESIDUAL, S.PREDICTIONS, RECOVERY, f"""grid AS (SELECT x.run || ':' || v.entity AS entity, component, attack, sim, score FROM resid x
  JOIN (SELECT * REPLACE ({_RUN_CASE} AS run) FROM recovery) v ON v.run = x.run AND CAST(v.entity AS BIGINT) % 10 = x.entity)""")


@register("j03_residual_x_recovery", _GRID + f"SELECT entity, component, attack, {r('sim')} AS sim, {r('score')} AS score FROM grid")
def j03(t: Tables):
    return J.residual_x_recovery(_residuals(t), _recovery(t))


_GR = _RANKED.format(g="component, attack", s="(SELECT component, attack, sim AS a, score AS b FROM grid)")
_OKC = "count(*) >= 3 AND min(round(a, 8)) < max(round(a, 8)) AND min(round(b, 8)) < max(round(b, 8))"


@register("k04_correlation_grid", _GRID[:-1] + f""", {_GR} SELECT component, attack, count(*) AS n, CASE WHEN {_OKC} THEN {r('corr(a, b)')} END AS pearson_r,
CASE WHEN {_OKC} THEN {r('corr(ra, rb)')} END AS spearman_r, CASE WHEN count(*) < 3 THEN 'insufficient data' WHEN {_OKC} THEN 'ok' ELSE 'constant input' END AS status
FROM rk GROUP BY component, attack""")
def k04(t: Tables):
    return K.correlation_grid(_residuals(t), _recovery(t), p_values=False)


@register("k05_trend_line", with_(VALUES) + f"SELECT run, {r('regr_slope(b, a)')} AS slope, {r('regr_intercept(b, a)')} AS intercept FROM vals GROUP BY run")
def k05(t: Tables):
    return K.trend_line(value_pairs(t), "x", "y", ["run"])


@register("j04_method_x_profile", with_(*_PAIRS, *cka_ctes("pairs", G), S.PREDICTIONS) + f"""SELECT p.run, c.component AS metric, {r('c.v')} AS value, {r('p.m')} AS mean_recovery
FROM (SELECT {_RUN_CASE} AS run, (avg(score) FILTER (WHERE attack = 'direct') + avg(score) FILTER (WHERE attack = 'rephrase') + avg(score) FILTER (WHERE attack = 'crop') + avg(score) FILTER (WHERE attack = 'perturb')) / 4 AS m
  FROM predictions GROUP BY predictions.run) p JOIN (SELECT run, component, avg(cka) AS v FROM cka GROUP BY run, component) c USING (run)""")
def j04(t: Tables):
    summary = A.attack_rates(t.predictions()).withColumn("run", _run_number()).filter(F.col("run").isNotNull())
    profile = C.component_summary(C.component_profile(t.pairs()))
    wide = profile.groupBy("run").pivot("component", V.COMPONENTS).agg(F.first("mean_cka"))
    return J.method_x_profile(summary.select("run", "mean_recovery"), wide, V.COMPONENTS)


@register("j09_length_vs_residual", with_(*_PAIRS, RESIDUAL) + f"""SELECT run, component, count(*) AS n, {r('corr(len, sim)')} AS corr FROM resid
JOIN (SELECT doc_id % 10 AS entity, avg(len({S.words('text')})) AS len FROM documents GROUP BY 1) d USING (entity) GROUP BY run, component""")
def j09(t: Tables):
    lengths = t.documents().groupBy((F.col("doc_id") % 10).cast("int").alias("entity")).agg(
        F.avg(T.word_count("text")).alias("len")
    )
    joined = C.entity_residual(t.pairs()).withColumn("entity", F.col("entity").cast("int")).join(lengths, "entity")
    return K.pearson(joined, "len", "sim", ["run", "component"]).select("run", "component", "n", F.col("pearson_r").alias("corr"))


@register("a14_audit_taxonomy", with_(*_PAIRS, *cka_ctes("pairs", G), S.PREDICTIONS, S.BEHAVIOUR, S.DELTAS) + f"""SELECT d.run, {r('g.cka')} AS cka,
CASE WHEN delta_retain <= -0.2 THEN 'destructive_collapse' WHEN delta_forget >= -0.01 AND delta_retain >= -0.05 AND g.cka >= 0.95 THEN 'under_forgetting'
 WHEN delta_forget >= -0.01 AND delta_retain >= -0.05 THEN 'hidden_drift' WHEN delta_retain >= -0.05 THEN 'candidate_partial_forgetting' ELSE 'unclassified' END AS diagnosis
FROM (SELECT {_RUN_CASE} AS run, delta_forget, delta_retain FROM deltas) d JOIN (SELECT run, min(v) AS cka FROM (SELECT run, component, avg(cka) AS v FROM cka GROUP BY run, component) GROUP BY run) g USING (run)""")
def a14(t: Tables):
    deltas = A.behaviour_deltas(A.behaviour_table(t.predictions()), BASE_RUN).withColumn("run", _run_number())
    return A.audit_taxonomy(deltas, C.component_summary(C.component_profile(t.pairs())))


_SPREAD = 0.01


@register("g10_cka_checks", _CKA[:-1] + f""", pm AS (SELECT run, component, avg(cka) AS v FROM cka GROUP BY run, component)
SELECT 'rates in range' AS "check", CASE WHEN count(*) FILTER (WHERE v < 0 OR v > 1) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) FILTER (WHERE v < 0 OR v > 1) AS n_bad FROM pm
UNION ALL SELECT 'mean_cka spread', CASE WHEN abs(max(v) - min(v) - {_SPREAD}) < 1e-3 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN abs(max(v) - min(v) - {_SPREAD}) < 1e-3 THEN 0 ELSE 1 END FROM pm""")
def g10_cka(t: Tables):
    return Q.range_checks(C.component_summary(C.component_profile(t.pairs())), ["mean_cka"], expected_spread={"mean_cka": _SPREAD})


@register("k06_method_correlation", with_(*_PAIRS, *cka_ctes("pairs", G), S.PREDICTIONS, f"""grid AS (SELECT c.component AS metric, c.v AS a, p.m AS b
FROM (SELECT {_RUN_CASE} AS run, (avg(score) FILTER (WHERE attack = 'direct') + avg(score) FILTER (WHERE attack = 'rephrase') + avg(score) FILTER (WHERE attack = 'crop') + avg(score) FILTER (WHERE attack = 'perturb')) / 4 AS m
  FROM predictions GROUP BY predictions.run) p JOIN (SELECT run, component, avg(cka) AS v FROM cka GROUP BY run, component) c USING (run))""", _RANKED.format(g="metric", s="grid"))
  + f"""SELECT metric, count(*) AS n, CASE WHEN {_OKC} THEN {r('corr(a, b)')} END AS pearson_r, CASE WHEN {_OKC} THEN {r('corr(ra, rb)')} END AS spearman_r,
CASE WHEN count(*) < 3 THEN 'insufficient data' WHEN {_OKC} THEN 'ok' ELSE 'constant input' END AS status FROM rk GROUP BY metric""")
def k06(t: Tables):
    """Do methods that keep a component recover more?  One row per metric."""
    return K.correlate(j04(t), "value", "mean_recovery", ["metric"], p_values=False)


# -- bootstraps ------------------------------------------------------------------------
N_REP = 1000


def draws(source: str, unit: str, reps: int = N_REP, by: str = "", p: str = "") -> str:
    """CTEs `units` and `drawn` (by, unit, replicate, w) with the shared md5 draws."""
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""{p}units AS (SELECT {b}{unit}, row_number() OVER ({part}ORDER BY {unit}) - 1 AS unit_index, count(*) OVER ({part}) AS n_units FROM (SELECT DISTINCT {b}{unit} FROM {source})),
{p}drawn_idx AS (SELECT {b}replicate, unit_index AS slot, CAST(('0x' || substr(md5('42|' || CAST(replicate AS VARCHAR) || '|' || CAST(unit_index AS VARCHAR)), 1, 8)) AS BIGINT) % n_units AS unit_index
  FROM {p}units, (SELECT unnest(range(0, {reps})) AS replicate)),
{p}drawn AS (SELECT {b}{unit}, replicate, w FROM (SELECT {b}replicate, unit_index, count(*) AS w FROM {p}drawn_idx GROUP BY ALL) JOIN {p}units USING ({b}unit_index))"""


@register("b01_draw_indices", with_(draws("embeddings", "vec_id")) + "SELECT replicate, slot, unit_index FROM drawn_idx")
def b01(t: Tables):
    return B.draw_indices(t.table("embeddings"), "vec_id", N_REP)


_U = range(1, 9)  # units of a layer


def _sums() -> dict[str, str]:
    """Moments of rows x, y with k = |x|^2 and l = |y|^2: name and term."""
    out = {"n": "1.0::DOUBLE", "k": "k", "l": "l", "kl": "k * l", "kk": "k * k", "ll": "l * l"}
    for i in _U:
        out |= {f"x{i}": f"x[{i}]", f"y{i}": f"y[{i}]", f"kx{i}": f"k * x[{i}]", f"ky{i}": f"k * y[{i}]", f"lx{i}": f"l * x[{i}]", f"ly{i}": f"l * y[{i}]"}
        out |= {f"xy{i}_{j}": f"x[{i}] * y[{j}]" for j in _U}
        out |= {f"xx{i}_{j}": f"x[{i}] * x[{j}]" for j in _U if j >= i} | {f"yy{i}_{j}": f"y[{i}] * y[{j}]" for j in _U if j >= i}
    return out


def _boot(unit: str, p: str = "") -> list[str]:
    """CKA of every replicate from weighted sums of moments per unit."""
    every = _sums()

    def plus(terms) -> str:
        return "(" + " + ".join(terms) + ")"

    def at(s: str, i: int, j: int) -> str:
        return f"{s}{i}_{j}" if s == "xy" else f"{s}{min(i, j)}_{max(i, j)}"

    def square(s: str) -> str:
        return plus(f"pow({at(s, i, j)} - {s[0]}{i} * {s[1]}{j} / n, 2)" for i in _U for j in _U)

    def form(s: str) -> str:
        return plus(f"{s[0]}{i} * {at(s, i, j)} * {s[1]}{j}" for i in _U for j in _U) + " / (n * n)"

    def dot(u: str, v: str) -> str:
        return plus(f"{u}{i} * {v}{i}" for i in _U) + " / n"

    g = f"{G}, replicate"
    return [
        draws("pairs", unit, p=p),
        f"{p}mom AS (SELECT {G}, {unit}, {', '.join(f'sum({v}) AS {c}' for c, v in every.items())} FROM (SELECT *, list_sum(list_transform(x, lambda v: v * v)) AS k, list_sum(list_transform(y, lambda v: v * v)) AS l FROM pairs) GROUP BY {G}, {unit})",
        f"{p}tot AS (SELECT {g}, {', '.join(f'sum(w * {c}) AS {c}' for c in every)} FROM {p}mom JOIN {p}drawn USING ({unit}) GROUP BY {g})",
        f"{p}cen AS (SELECT *, {square('xx')} AS fxx, {square('xy')} AS fxy, {square('yy')} AS fyy, {dot('x', 'x')} / n AS a, {dot('y', 'y')} / n AS b FROM {p}tot)",
        f"""{p}crossed AS (SELECT {g}, n, fxx, fxy, fyy, k - n * a AS tk, l - n * b AS tl,
  kl - 2 * {dot('y', 'ky')} - 2 * {dot('x', 'lx')} + 4 * {form('xy')} + b * k + a * l - 3 * a * b * n AS kl,
  kk - 4 * {dot('x', 'kx')} + 4 * {form('xx')} + 2 * a * k - 3 * a * a * n AS kk,
  ll - 4 * {dot('y', 'ly')} + 4 * {form('yy')} + 2 * b * l - 3 * b * b * n AS ll FROM {p}cen)""",
        f"""{p}hsic AS (SELECT {g},
  (fxy - kl - 2 * kl / (n - 2) + tk * tl / ((n - 1) * (n - 2))) / (n * (n - 3)) AS hxy,
  (fxx - kk - 2 * kk / (n - 2) + tk * tk / ((n - 1) * (n - 2))) / (n * (n - 3)) AS hxx,
  (fyy - ll - 2 * ll / (n - 2) + tl * tl / ((n - 1) * (n - 2))) / (n * (n - 3)) AS hyy FROM {p}crossed WHERE n >= 4)""",
        f"{p}cka AS (SELECT {g}, CASE WHEN hxx > 0 AND hyy > 0 THEN least(1.0, greatest(0.0, hxy / sqrt(greatest(hxx * hyy, 1e-10)))) END AS cka FROM {p}hsic)",
    ]


def _interval(value: str, by: str) -> str:
    return f"""{by}, {r(f"CASE WHEN count({value}) >= 2 THEN quantile_cont({value}, 0.025) END")} AS lo, {r(f"CASE WHEN count({value}) >= 2 THEN quantile_cont({value}, 0.975) END")} AS hi, count({value}) AS n_ok"""


@register("b02_example_bootstrap", with_(*_PAIRS, *_boot("item_id")) + f"SELECT {_interval('cka', G)} FROM cka GROUP BY {G}")
def b02(t: Tables):
    return B.cka_bootstrap(t.pairs(), "item_id", N_REP)


@register("b02_example_replicates", with_(*_PAIRS, *_boot("item_id")) + f"SELECT {G}, replicate, {r('cka')} AS value FROM cka")
def b02_reps(t: Tables):
    return B.cka_replicates(t.pairs(), "item_id", N_REP)


@register("b03_cluster_bootstrap", with_(*_PAIRS, *_boot("entity")) + f"SELECT {_interval('cka', G)} FROM cka GROUP BY {G}")
def b03(t: Tables):
    return B.cka_bootstrap(t.pairs(), "entity", N_REP)


ENTITY_VALUES = "ev AS (SELECT run, entity, avg(score) AS v FROM predictions GROUP BY run, entity)"
_EV = (S.PREDICTIONS, ENTITY_VALUES, draws("ev", "entity", by="run"),
       "reps AS (SELECT run, replicate, sum(w * v) / sum(w) AS value FROM drawn JOIN ev USING (run, entity) GROUP BY run, replicate HAVING sum(w) >= 4)")


def entity_values(t: Tables):
    return t.predictions().groupBy("run", "entity").agg(F.avg("score").alias("v"))


def value_reps(t: Tables):
    return B.value_replicates(entity_values(t), "entity", "v", N_REP, by=["run"])


@register("b04_entity_value_bootstrap", with_(*_EV) + f"SELECT {_interval('value', 'run')} FROM reps GROUP BY run")
def b04(t: Tables):
    return B.value_bootstrap(entity_values(t), "entity", "v", N_REP, by=["run"])


@register("b05_layer_mean_bootstrap", with_(*_PAIRS, *_boot("item_id")) + f"SELECT run, component, replicate, {r('avg(cka)')} AS value FROM cka GROUP BY run, component, replicate")
def b05(t: Tables):
    return B.layer_mean_replicates(B.cka_replicates(t.pairs(), "item_id", N_REP))


_WIDTH = "SELECT {g}, quantile_cont(cka, 0.975) - quantile_cont(cka, 0.025) AS width FROM {c} GROUP BY {g}"


@register("b06_cluster_vs_example", with_(*_PAIRS, *_boot("item_id"), *_boot("entity", "e")) + f"""SELECT {G}, {r('a.width')} AS width_example, {r('b.width')} AS width_cluster, b.width > a.width AS cluster_wider
FROM ({_WIDTH.format(g=G, c='cka')}) a JOIN ({_WIDTH.format(g=G, c='ecka')}) b USING ({G})""")
def b06(t: Tables):
    pairs = t.pairs()
    return B.cluster_vs_example(B.cka_bootstrap(pairs, "item_id", N_REP), B.cka_bootstrap(pairs, "entity", N_REP), C.PROFILE)


@register("b07_paired_difference", with_(*_EV) + f"""SELECT run_a, run_b, {r('avg(d)')} AS mean_diff, {r('quantile_cont(d, 0.025)')} AS lo, {r('quantile_cont(d, 0.975)')} AS hi,
quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero FROM (SELECT a.run AS run_a, b.run AS run_b, a.value - b.value AS d FROM reps a JOIN reps b USING (replicate) WHERE a.run < b.run) GROUP BY run_a, run_b""")
def b07(t: Tables):
    return B.paired_difference(value_reps(t), [])


@register("b07_paired_cka_difference", with_(*_PAIRS, *_boot("entity")) + f"""SELECT component, layer, run_a, run_b, {r('avg(d)')} AS mean_diff, {r('quantile_cont(d, 0.025)')} AS lo, {r('quantile_cont(d, 0.975)')} AS hi,
quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero FROM (SELECT component, layer, a.run AS run_a, b.run AS run_b, a.cka - b.cka AS d
FROM cka a JOIN cka b USING (component, layer, replicate) WHERE a.run < b.run) GROUP BY ALL""")
def b07_cka(t: Tables):
    return B.paired_difference(B.cka_replicates(t.pairs(), "entity", N_REP), ["component", "layer"])


@register("b08_ci_audit", with_(*_EV) + f"""SELECT run, {r('point')} AS point, {r('m')} AS mean, {r('med')} AS median, {r('sd')} AS sd, {r('m - point')} AS bias, {r('lo')} AS pct_lo, {r('hi')} AS pct_hi,
{r('2 * point - hi')} AS basic_lo, {r('2 * point - lo')} AS basic_hi, point BETWEEN lo AND hi AS point_inside, run <> 'view' AS stored_matches,
CASE WHEN run = 'view' OR run = 'error' THEN 'FAIL' WHEN point BETWEEN lo AND hi THEN 'PASS' ELSE 'WARN' END AS verdict
FROM (SELECT run, avg(value) AS m, median(value) AS med, stddev_samp(value) AS sd, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM reps GROUP BY run)
JOIN (SELECT run, avg(v) AS point FROM ev GROUP BY run) USING (run)""")
def b08(t: Tables):
    reps = value_reps(t)
    point = entity_values(t).groupBy("run").agg(F.avg("v").alias("point"))
    stored = B.percentile_interval(reps, ["run"]).join(point, "run").select(
        "run", "point",
        (F.col("lo") + F.when(F.col("run") == "view", 1e-6).otherwise(0.0)).alias("lo"), "hi",
        F.lit(N_REP).alias("n_bootstrap"), (F.col("run") != "error").alias("paired"),
    )
    return B.ci_audit(reps, stored, ["run"])


@register("b09_mean_ci", with_("ev AS (SELECT o_custkey AS entity, avg(o_totalprice) AS v FROM orders GROUP BY o_custkey)", draws("ev", "entity"),
    "reps AS (SELECT replicate, sum(w * v) / sum(w) AS value FROM drawn JOIN ev USING (entity) GROUP BY replicate)") + f"""SELECT {r("quantile_cont(value, 0.025)")} AS lo, {r("quantile_cont(value, 0.975)")} AS hi, count(value) AS n_ok FROM reps""")
def b09(t: Tables):
    values = t.table("orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.avg("o_totalprice").alias("v"))
    return B.value_bootstrap(values, "entity", "v", N_REP)
