"""Moments and blocks against textbook n x n formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from remnant.functions import kernels as K
from remnant.functions.common import hash_key, hash_uniform
from remnant.operators import bootstrap as B
from remnant.operators import pairwise as W
from remnant.operators import similarity as C

RNG = np.random.default_rng(3)
N, P = 40, 6
X = RNG.normal(size=(N, P)) + 50.0
Y = X @ RNG.normal(size=(P, P)) + RNG.normal(size=(N, P))
ENT = [f"e{i % 8 if i % 3 else 0}" for i in range(N)]  # e0 holds a third and more


def debiased(x, y):
    x, y = x - x.mean(0), y - y.mean(0)
    n = len(x)
    k, l = x @ x.T, y @ y.T
    np.fill_diagonal(k, 0)
    np.fill_diagonal(l, 0)

    def hsic(a, b):
        return (np.trace(a @ b) + a.sum() * b.sum() / ((n - 1) * (n - 2)) - 2 * (a @ b).sum() / (n - 2)) / (n * (n - 3))

    return float(np.clip(hsic(k, l) / np.sqrt(max(hsic(k, k) * hsic(l, l), 1e-10)), 0, 1))


def biased(x, y):
    x, y = x - x.mean(0), y - y.mean(0)
    return np.linalg.norm(y.T @ x) ** 2 / (np.linalg.norm(x.T @ x) * np.linalg.norm(y.T @ y))


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(1, "lb", 0, i, ENT[i], "forget", X[i].tolist(), Y[i].tolist()) for i in range(N)]
    schema = "run int, component string, layer int, item_id long, entity string, split string, x array<double>, y array<double>"
    return spark.createDataFrame(rows, schema).repartition(5).cache()


def one(df, c):
    r = df.collect()
    assert len(r) == 1
    return r[0][c]


def test_linear_cka(pairs):
    assert one(C.cka(pairs), "cka") == pytest.approx(debiased(X, Y), abs=1e-12)
    assert one(C.cka(pairs, kind="biased"), "cka") == pytest.approx(biased(X, Y), abs=1e-12)
    assert one(C.cka(pairs.withColumn("y", F.col("x"))), "cka") == pytest.approx(1.0)


def test_invariance_and_small_groups(pairs):
    q, _ = np.linalg.qr(RNG.normal(size=(P, P)))
    assert debiased(X, 3 * Y @ q) == pytest.approx(debiased(X, Y))
    assert one(C.cka(pairs.withColumn("y", F.transform("y", lambda v: v * 7 + 2)).coalesce(1)), "cka") == pytest.approx(debiased(X, Y), abs=1e-10)
    assert one(C.cka(pairs.filter("item_id < 3")), "cka") is None
    assert one(C.cka(pairs.withColumn("y", F.transform("y", lambda v: F.lit(1.0)))), "cka") is None
    assert C.component_profile(pairs.filter("item_id < 3")).count() == 0


def test_probe_solves_the_ridge_equations(pairs):
    acts = pairs.withColumnRenamed("x", "vec").withColumn("label", (F.col("item_id") % 2).cast("double"))
    fold = F.pmod(F.xxhash64("entity"), F.lit(2)).alias("fold")
    of = np.array([r.fold for r in acts.select("item_id", fold).orderBy("item_id").collect()])
    y = np.arange(N) % 2
    got = {r.fold: r for r in C.entity_disjoint_probe(acts, "label").collect()}
    assert set(got) == set(of)
    for f in set(of):
        a, b = X[of != f], y[of != f]
        m = a.mean(0)
        w = np.linalg.solve((a - m).T @ (a - m) + 1e-3 * len(a) * np.eye(P), (a - m).T @ (b - b.mean()))
        hit = ((X[of == f] - m) @ w + b.mean() >= 0.5) == y[of == f]
        assert got[f].n == (of == f).sum() and got[f].accuracy == pytest.approx(hit.mean())


def logistic(x, y, ridge):
    """Weights by descent with a bound on the curvature, on centred features, until nothing changes."""
    m = x.mean(0)
    x = np.column_stack([x - m, np.ones(len(x))])
    d = np.diag([*[ridge * len(x)] * (x.shape[1] - 1), 0.0])
    step, w = np.linalg.inv(x.T @ x / 4 + d), np.zeros(x.shape[1])
    for _ in range(5_000):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + d @ w
        w = w - step @ g
    assert np.abs(g).max() < 1e-9
    return np.append(w[:-1], w[-1] - w[:-1] @ m)


@pytest.mark.parametrize("folds, ridge", [(2, 1e-3), (3, 0.1)])
def test_logistic_probe_against_descent(spark, pairs, folds, ridge):
    acts = pairs.withColumnRenamed("x", "vec").withColumn("label", (F.col("item_id") % 2).cast("double"))
    fold = hash_uniform(hash_key("fold", "entity"), F.lit(folds)).alias("fold")
    of = np.array([r.fold for r in acts.select("item_id", fold).orderBy("item_id").collect()])
    y = np.arange(N) % 2
    got = {r.fold: r for r in C.logistic_probe(acts, "label", folds=folds, ridge=ridge).collect()}
    assert set(got) == set(of) and len(got) > 1
    for f in set(of):
        w = logistic(X[of != f], y[of != f], ridge)
        z = X[of == f] @ w[:-1] + w[-1]
        assert got[f].weights == pytest.approx(list(w), abs=1e-6) and got[f].n == (of == f).sum()
        assert got[f].accuracy == pytest.approx(((z >= 0) == y[of == f]).mean())
        assert got[f].log_loss == pytest.approx((np.logaddexp(0, z) - y[of == f] * z).mean(), abs=1e-6)


def test_logistic_probe_of_separable_null_and_single_labels(spark):
    """Separated classes far from zero, one label only, NULL groups and labels, one fold."""
    rows = [(None, "c", 0, f"e{i}", [1000.0 + i, float(i % 2)], float(i % 2)) for i in range(40)]
    rows += [(1, "c", None, f"e{i}", [float(i), 2.0], 1.0) for i in range(12)]
    rows += [(1, "c", 1, "same", [float(i), 2.0], float(i % 2)) for i in range(6)]
    rows += [(1, "c", None, "e1", [9.0, 9.0], None)]
    acts = spark.createDataFrame(rows, "run int, component string, layer int, entity string, vec array<double>, label double")
    got = C.logistic_probe(acts, "label").collect()
    assert {(r.run, r.layer) for r in got} == {(None, 0), (1, None)}
    assert all(r.accuracy == 1.0 for r in got)
    assert sum(r.n for r in got if r.run is None) == 40 and sum(r.n for r in got if r.run == 1) == 12
    assert C.logistic_probe(acts.limit(0), "label").count() == 0


def test_translate_is_exact():
    t = K.summed_features(X - 50, Y)
    d, e = RNG.normal(size=P), RNG.normal(size=P)
    assert np.allclose(K.translate(t, P, P, d, e)[0], K.summed_features(X - 50 - d, Y - e))
    assert np.allclose(K.row_features(X, Y).sum(0), K.summed_features(X, Y))


def test_flush_keeps_sums(pairs, monkeypatch):
    monkeypatch.setattr(K, "FLUSH_DOUBLES", 1)
    assert one(C.cka(pairs), "cka") == pytest.approx(debiased(X, Y), abs=1e-12)


def test_influence(pairs):
    got = {r.entity: r for r in C.influence_loeo(pairs).collect()}
    keep = np.array([e != "e0" for e in ENT])
    assert got["e0"].cka_without == pytest.approx(debiased(X[keep], Y[keep]), abs=1e-10)
    assert got["e0"].influence == pytest.approx(debiased(X[keep], Y[keep]) - debiased(X, Y), abs=1e-10)


@pytest.mark.parametrize("unit, names", [("item_id", list(range(N))), ("entity", ENT)])
def test_bootstrap_equals_physical_resampling(pairs, unit, names):
    reps = {r.replicate: r.value for r in B.cka_replicates(pairs, unit, 6).collect()}
    index = sorted(set(names))
    draws = {}
    for r in B.draw_indices(pairs, unit, 6).collect():
        draws.setdefault(r.replicate, []).append(index[r.unit_index])
    for rep, units in draws.items():
        idx = [i for u in units for i in range(N) if names[i] == u]
        assert reps[rep] == pytest.approx(debiased(X[idx], Y[idx]), abs=1e-9)
    ci = B.cka_bootstrap(pairs, unit, 6).first()
    vals = list(reps.values())
    assert ci.lo == pytest.approx(np.percentile(vals, 2.5)) and ci.hi == pytest.approx(np.percentile(vals, 97.5))


def test_draws_do_not_depend_on_partitions(pairs):
    a = sorted(map(tuple, B.draw_counts(pairs.coalesce(1), "item_id", 5).collect()))
    b = sorted(map(tuple, B.draw_counts(pairs.repartition(7), "item_id", 5).collect()))
    assert a == b


def rbf(x, y):
    def kern(z):
        d = ((z[:, None] - z[None]) ** 2).sum(-1)
        s = np.sqrt(np.sort(d.ravel())[(d.size - 1) // 2]) + 1e-8
        h = np.eye(len(z)) - 1 / len(z)
        return h @ np.exp(-d / (2 * s * s)) @ h

    a, b = kern(x), kern(y)
    return (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())


@pytest.mark.parametrize("block", [512, 7])
def test_rbf_cka(pairs, block):
    assert one(W.rbf_cka(pairs, block=block), "cka") == pytest.approx(rbf(X, Y), abs=1e-9)


def matrix(z, metric):
    if metric == "euclidean":
        return np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    if metric == "correlation":
        z = z - z.mean(1, keepdims=True)
        return 1 - (z @ z.T) / np.outer(*[np.linalg.norm(z, axis=1)] * 2)
    z = z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-8)
    return 1 - z @ z.T


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "correlation"])
def test_item_rdm_and_rsa(pairs, metric):
    dx, dy = matrix(X, metric), matrix(Y, metric)
    rows = W.rdm(pairs, metric, block=9).collect()
    assert len(rows) == N * (N - 1) // 2
    for r in rows[::50]:
        assert r.i < r.j and r.d_x == pytest.approx(dx[r.i, r.j], abs=1e-6) and r.d_y == pytest.approx(dy[r.i, r.j], abs=1e-6)
    iu = np.triu_indices(N, 1)
    rank = lambda v: np.argsort(np.argsort(v))
    want = np.corrcoef(rank(dx[iu]), rank(dy[iu]))[0, 1]
    got = W.rsa(pairs, metric, block=9).first()
    assert got.rho == pytest.approx(want, abs=1e-6) and 0 <= got.p <= 1 and got.n == len(rows)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "correlation"])
def test_rsa_without_stored_pairs(spark, pairs, metric):
    """Equal to the ranking of stored pairs, with ties, repeated items, an outlier and NULL groups."""
    tied = pairs.withColumn("y", F.transform("y", lambda v: F.round(v / 40))).withColumn("run", F.lit(2))
    far = pairs.withColumn("x", F.when(F.col("item_id") == 0, F.transform("x", lambda v, j: v * (1 + 1000.0 * j))).otherwise(F.col("x"))).withColumn("run", F.lit(3))
    every = pairs.unionByName(tied).unionByName(far)
    want = {r.run: r for r in W.rsa(every, metric, block=9).collect()}
    got = {r.run: r for r in W.rsa_of_items(every, metric, block=3).collect()}
    assert set(got) == set(want) and len(got) == 3
    for k, r in got.items():
        assert r.n == want[k].n and r.rho == pytest.approx(want[k].rho, abs=2e-6) and r.p == pytest.approx(want[k].p, abs=1e-5)
    coarse = W.rsa_of_items(pairs, metric, block=9, cells=128).first()
    assert coarse.rho == pytest.approx(got[1].rho, abs=1e-3)
    assert W.rsa_of_items(pairs.withColumn("y", F.array(F.lit(1.0), F.lit(2.0))).withColumn("layer", F.lit(None).cast("int")), metric).first().rho is None
    assert W.rsa_of_items(pairs.limit(0), metric).count() == 0


def test_pooled_vectors_have_no_layer(pairs):
    pooled = pairs.withColumn("layer", F.lit(None).cast("int"))
    assert W.rdm(pooled, block=9).count() == N * (N - 1) // 2
    assert W.rbf_cka(pooled, block=9).first().cka == pytest.approx(W.rbf_cka(pairs, block=9).first().cka)


def test_health(spark, pairs):
    acts = "run int, component string, layer int, item_id long, vec array<double>"
    nan = float("nan")
    rows = [(1, "ve", 0, i, [1.0, 2.0]) for i in range(4)] + [(1, "br", 0, i, [0.0, 0.0]) for i in range(4)]
    rows += [(1, "lb", 0, i, [nan, 1.0]) for i in range(4)] + [(2, "ve", 0, 1, [1.0]), (2, "ve", 0, 2, [1.0, 2.0])] + [(2, "br", 0, 1, [1.0])]
    got = {(r.run, r.component): r.verdict for r in C.matrix_health(spark.createDataFrame(rows, acts), None).collect()}
    assert got == {(1, "ve"): "PASS", (1, "br"): "WARN", (1, "lb"): "FAIL", (2, "ve"): "FAIL", (2, "br"): "PASS"}
    short = C.matrix_health(spark.createDataFrame(rows[:4], acts), 5).first()
    assert short.verdict == "FAIL"
    w = [("ok", "x.lora_B.w", [0.0, 1.0]), ("ok", "x.lora_A.w", [nan]), ("zero", "x.lora_B.w", [0.0]), ("nan", "lora_B", [nan, 1.0]), ("none", "lora_A", [1.0])]
    h = {r.checkpoint: r.verdict for r in C.weight_health(spark.createDataFrame(w, "checkpoint string, tensor string, values array<double>")).collect()}
    assert h == {"ok": "PASS", "zero": "FAIL", "nan": "FAIL", "none": "FAIL"}


def test_p_values():
    # Two-sided t tails: t = 2.228 with 10 degrees of freedom has p = 0.05.
    t, df = np.array([2.228139, 12.706205, 1.959964]), np.array([10, 1, 1e7])
    r = t / np.sqrt(df + t * t)
    assert np.allclose(K.correlation_p(r, df + 2), 0.05, atol=1e-6)
    assert np.isnan(K.correlation_p(0.5, 2))


@pytest.mark.parametrize("unit", ["item_id", "entity"])
def test_replicates_by_blocks_and_salts(spark, pairs, unit, monkeypatch):
    """Small blocks of replicates, slots and rows give what one block gives."""

    def values():
        return {tuple(r)[:-1]: r["value"] for r in B.cka_replicates(pairs, unit, 11).collect()}

    whole = values()
    monkeypatch.setattr(B, "BLOCK", 4)
    monkeypatch.setattr(B, "SLOTS", 3)
    monkeypatch.setattr(B, "ROWS", 2)
    parts = values()
    assert set(whole) == set(parts) and any(v is not None for v in whole.values())
    for k, v in whole.items():
        assert (v is None) == (parts[k] is None) and (v is None or abs(v - parts[k]) < 1e-9)


def test_drawn_lists_are_the_draws(spark, pairs):
    want = {}
    for r in B.draw_counts(pairs, "item_id", 9).collect():
        want[r["item_id"], r["replicate"]] = r["w"]
    units = B.indexed_units(pairs, "item_id")
    got = {}
    for r in units.join(B._drawn(units.select("n_units").distinct(), 9, B.SEED), ["n_units", "unit_index"]).collect():
        for k in r["reps"]:
            got[r["item_id"], r["r0"] + k] = got.get((r["item_id"], r["r0"] + k), 0) + 1
    assert got == want


def test_draws_are_not_sent_to_all_tasks(spark):
    """Draws look small to the planner, as they are made from one row; none of them may be broadcast."""
    values = spark.range(40).select("id", F.col("id").cast("double").alias("v"))
    for reps in (B.value_replicates(values, "id", "v", 3), B.cka_replicates(values.select(F.lit(0).alias("run"), F.col("id").alias("item_id"), F.array("v").alias("x"), F.array("v").alias("y")), "item_id", 3, by=["run"])):
        plan = reps._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.split("\n") if "Broadcast" in line and "n_units" in line]
        assert "MapInArrow" in plan and not joins, plan


@pytest.mark.parametrize("rows", [1 << 14, 7])
def test_value_replicates_are_means_of_the_draws(spark, rows, monkeypatch):
    """Tiles of few units and one tile give the means over draw_indices, per group."""
    monkeypatch.setattr(B, "ROWS", rows)
    values = spark.range(50).select("id", (F.col("id") * F.col("id")).cast("double").alias("v"), F.when(F.col("id") < 20, "a").otherwise("b").alias("run"))
    units = B.indexed_units(values, "id", ["run"]).join(values, ["run", "id"])
    drawn = B.draw_indices(values, "id", 130, by=["run"]).join(units.select("run", "unit_index", "v"), ["run", "unit_index"])
    want = {(r[0], r[1]): r[2] for r in drawn.groupBy("run", "replicate").agg(F.avg("v")).collect()}
    got = {(r["run"], r["replicate"]): r["value"] for r in B.value_replicates(values, "id", "v", 130, by=["run"]).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_draws_fill_many_tasks(spark, monkeypatch):
    """The units of one task are dealt out before their draws are listed."""
    monkeypatch.setattr(B, "_tasks", lambda df: 6)
    draws = B.draw_indices(spark.range(200).coalesce(1), "id", 5)
    rows = [r[0] for r in draws.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(rows) == 1000 and len(rows) == 6 and max(rows) < 300


def test_blocks_hold_many_items(spark):
    """Items are sent once per block pair: 2,000 of a group are one block, and tiles of it give all pairs."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(2, 1200, 4))
    rows = [(0, i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    pairs = spark.createDataFrame(rows, "run int, item_id bigint, x array<double>, y array<double>")
    assert W.block_pairs(W.item_blocks(pairs, ["run"]), ["run"]).count() == 1
    sq = [((v[:, None] - v[None]) ** 2).sum(-1) for v in (x, y)]
    k = [np.exp(-d / (2 * (np.sqrt(np.sort(d.ravel())[(d.size - 1) // 2]) + 1e-8) ** 2)) for d in sq]
    k = [v - v.mean(0) - v.mean(1)[:, None] + v.mean() for v in k]
    want = (k[0] * k[1]).sum() / np.sqrt((k[0] ** 2).sum() * (k[1] ** 2).sum())
    assert abs(W.rbf_cka(pairs, ["run"]).first()["cka"] - want) < 1e-9
    assert abs(W.rbf_cka(pairs, ["run"], block=300).first()["cka"] - want) < 1e-9


def test_counts_of_few_and_many():
    v = np.random.default_rng(2).integers(0, 50, 3_000_000) * 1000
    few, many = K._Counts(), K._Counts()
    few.add(v[:100], 2)
    for part in np.array_split(v, 5):
        many.add(part)
    for got, want, times in ((few, v[:100], 2), (many, v, 1)):
        bins, counts = np.unique(want, return_counts=True)
        assert (got.bins()[0] == bins).all() and (got.bins()[1] == times * counts).all()


def test_correlation_of_values_that_differ_when_computed_again(spark):
    """Sums of doubles in the order of arrival: ranks are joined by value, and no row may be lost."""
    from pyspark.sql.types import DoubleType

    from remnant.operators.stats import correlate

    def jitter(v):
        return v + np.random.default_rng().uniform(0, 1e-12, len(v))

    noisy = F.pandas_udf(jitter, DoubleType()).asNondeterministic()
    rows = spark.range(8).select(F.lit("m").alias("g"), noisy(F.col("id").cast("double")).alias("x"), noisy((F.col("id") % 5).cast("double")).alias("y"))
    got = correlate(rows, "x", "y", ["g"], p_values=False).collect()
    assert [(r["n"], r["status"]) for r in got] == [(8, "ok")]


def lower_median(v):
    d = np.sort(((v[:, None] - v[None]) ** 2).sum(-1).ravel())
    return np.sqrt(d[(d.size - 1) // 2]) + 1e-8


def test_medians_in_one_pass_over_distinct_sides(spark):
    """Runs that share a base have its distances counted once; ties, few items, shifted and copied vectors, and NaN."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4))
    sides = {
        1: (x, x + rng.normal(size=x.shape)), 2: (x, np.round(x)), 3: (x, x + 1000.0),
        4: (x[:1], x[:1]), 5: (x[:2], 2 * x[:2]), 6: (x[:3], x[3:6]),
        7: (np.repeat(x[:150], 2, 0), (x > 0).astype(float)), 8: (x[:40], np.zeros((40, 4))),
    }
    rows = [(run, i, a.tolist(), b.tolist()) for run, (v, w) in sides.items() for i, (a, b) in enumerate(zip(v, w))]
    rows += [(9, i, a.tolist(), [float("nan"), 1.0]) for i, a in enumerate(x[:20])]
    pairs = spark.createDataFrame(rows, "run int, item_id bigint, x array<double>, y array<double>")
    packed = W._packed(pairs, ["run"], 100, "squared", W.SHIFTS)
    found = {r.run: r for r in W.sigma_of_blocks(packed, ["run"]).collect()}
    assert set(found) == {*sides, 9}
    for run, (v, w) in sides.items():
        assert found[run].sigma_x == pytest.approx(lower_median(v), rel=1e-9), run
        assert found[run].sigma_y == pytest.approx(lower_median(w), rel=1e-9), run
    assert found[9].sigma_x == pytest.approx(lower_median(x[:20]), rel=1e-9) and found[9].sigma_y == np.inf  # as median_sigma has it
    shared = packed.filter("run < 3")
    # One base and two others, each of three blocks with six pairs of blocks.
    assert W._side_pairs(shared, W._brackets(shared, ["run"]), ["run"]).count() == 3 * 6
    # The kernels of both runs are taken over six pairs of blocks together.
    sigma = W.sigma_of_blocks(shared, ["run"])
    sums = W._base_pairs(shared, sigma, ["run"], ["sigma_x"], ["sigma_y"], "ids")
    assert sums.count() == 6 and sums.filter("b IS NULL").count() == 3
    got = {r.run: r.cka for r in W.rbf_cka(pairs.filter("run < 4"), ["run"], block=100).collect()}
    assert got == {run: pytest.approx(rbf(*sides[run]), abs=1e-9) for run in (1, 2, 3)}
    assert W.rbf_cka(pairs.filter("run = 1"), ["run"], block=100).first().cka == pytest.approx(rbf(*sides[1]), abs=1e-9)


def test_bracket_of_sampled_pairs_holds_the_median():
    """More items than are taken whole: the sampled bracket is narrow, and counts in it give the median."""
    v = np.random.default_rng(3).normal(size=(2500, 3))
    points, m = K._sampled(v, "squared", 8)
    d = np.sort(((v[:, None] - v[None]) ** 2).sum(-1)[np.triu_indices(2500, 1)])
    at = np.searchsorted(d, points[[K.POINTS // 4, K.POINTS // 2, 3 * K.POINTS // 4]]) / len(d)
    assert m > 1e6 and np.abs(at - [0.25, 0.5, 0.75]).max() < 3e-3
    v = np.sort(np.random.default_rng(4).normal(size=1000) ** 2).view(np.int64)
    assert (K._from_planes(K._planes(v)) == v).all()


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "correlation"])
def test_ranks_by_bins_or_by_bits(spark, metric):
    """Spread distances are ranked in bins, counted once for a shared base; equal ones and NaN by their bits."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5))
    sides = {
        1: (x, x + rng.normal(size=x.shape)), 2: (x, x - 0.3 * rng.normal(size=x.shape)),
        3: (x, np.repeat(rng.normal(size=(3, 5)), 100, 0)), 4: (x[:250], np.vstack([x[:249] * 2, 1e9 * x[249:250]])),
        5: (x, np.where(np.arange(300)[:, None] == 7, np.nan, x[::-1])),
    }
    rows = [(run, i, a.tolist(), b.tolist()) for run, (v, w) in sides.items() for i, (a, b) in enumerate(zip(v, w))]
    pairs = spark.createDataFrame(rows, "run int, item_id bigint, x array<double>, y array<double>")
    packed = W._packed(pairs, ["run"], 100, metric, 1)
    ranked, odd = W._by_bins(packed, ["run"], metric, 1 << 12)
    by_bits = {3, 5, 4} if metric == "euclidean" else {3, 5}  # the far one spreads the bins there
    assert {r.run for r in odd.collect()} == by_bits and {r.run for r in ranked.collect()} == set(sides) - by_bits
    found = {r.run: r for r in W.rsa_of_items(pairs, metric, ["run"], block=100, cells=1 << 12).collect()}
    whole = {r.run: r for r in W.rsa_of_items(pairs, metric, ["run"]).collect()}
    want = {r.run: r for r in W.rsa(pairs, metric, ["run"], p_values=False).collect()}
    assert set(found) == set(whole) == set(want) == set(sides)
    for run, r in want.items():
        assert whole[run].n == found[run].n == r.n
        assert whole[run].rho == pytest.approx(r.rho, abs=1e-9)
        assert found[run].rho == pytest.approx(r.rho, abs=1e-4 if run in by_bits else 2e-6), run
