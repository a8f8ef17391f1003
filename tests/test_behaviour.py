import pytest
from pyspark.sql import functions as F

from remnant.functions import fixed_values as V
from remnant.operators import alignment as J
from remnant.operators import behaviour as A
from remnant.operators import bootstrap as B
from remnant.operators import likelihood as L
from remnant.operators import neighborhood as N
from remnant.operators import quality as Q
from remnant.operators import stats as K

PRED = "run string, split string, entity string, question string, answer string, response string, correct boolean, position int"


def preds(spark, rows):
    return spark.createDataFrame(rows, PRED).withColumn("item_key", J.item_key(position="position"))


def test_last_duplicate_wins_and_blank_keys_use_position(spark):
    p = preds(spark, [
        ("base", "forget", "a", "q", "x", "r1", True, 0), ("base", "forget", "a ", " q", "x", "r2", False, 1),
        ("m", "forget", "a", "q", "x", "r3", True, 0), ("base", "forget", "", "", "z", "r4", True, 2), ("m", "forget", None, None, "zz", "r5", False, 2),
    ])
    got = {r.item_key: r for r in J.align_runs(p, "base", ["position"]).collect()}
    assert set(got) == {"a::q::x", "position::2"}
    assert got["a::q::x"].base_response == "r2" and not got["a::q::x"].base_correct


def test_positional_fallback_only_without_common_keys(spark):
    rows = [("base", "forget", f"b{i}", "q", "x", "r", True, i) for i in range(3)]
    rows += [("m", "forget", f"m{i}", "q", "x", "r", i > 0, i) for i in range(3)]
    rows += [("short", "forget", "s0", "q", "x", "r", True, 0)]
    p = preds(spark, rows)
    assert J.align_runs(p, "base", ["position"]).count() == 0
    got = J.align_runs(p, "base", ["position"], position="position").collect()
    assert sorted(r.run for r in got) == ["m"] * 3


def test_flips_cover_all_categories(spark):
    rows = [("m", s, f"{b}{m}", b, m) for s in ("forget", "retain") for b in (True, False) for m in (True, False)]
    al = spark.createDataFrame(rows + [("n", "forget", "k", True, True)], "run string, split string, item_key string, base_correct boolean, method_correct boolean")
    got = {(r.run, r.category): r.n for r in A.flip_counts(al).collect()}
    names = [c for d in V.FLIP_CATEGORIES.values() for c in d.values()]
    assert all(got["m", c] == 1 for c in names)
    assert got["n", "still_remembered"] == 1 and got["n", "successful_forgetting"] == 0
    s = {r.run: r for r in A.suppressed_items(al).collect()}
    assert (s["m"].n_suppressed, s["n"].n_suppressed) == (1, 0)
    att = spark.createDataFrame([("m", "TrueFalse", True), ("m", "TrueFalse", False)], "run string, item_key string, correct boolean")
    r = {x.run: (x.n_suppressed, x.n_recovered) for x in A.recovered_of_suppressed(al, att).collect()}
    assert r == {"m": (1, 1), "n": (0, 0)}


REGIMES = [
    (-0.5, -0.2, "COLLAPSE_OR_SEVERE_UTILITY_DAMAGE", "WARN"), (-0.1, -0.05, "DIRECTIONAL_SELECTIVE_FORGETTING", "PASS"),
    (0.0, 0.0, "UNDER_FORGETTING", "WARN"), (-0.1, -0.1, "FORGETTING_WITH_UTILITY_DAMAGE", "WARN"),
    (0.1, 0.0, "UNEXPECTED_RECOVERY_OR_RELEARNING", "WARN"), (0.0, -0.1, "NO_CLEAR_SELECTIVE_EFFECT", "WARN"),
]


def test_regime_and_verdict_rules(spark):
    d = spark.createDataFrame([(str(i), f, r) for i, (f, r, _, _) in enumerate(REGIMES)], "run string, delta_forget double, delta_retain double")
    got = {r.run: (r.regime, r.verdict) for r in A.regime(d).collect()}
    assert [got[str(i)] for i in range(len(REGIMES))] == [x[2:] for x in REGIMES]
    c = spark.createDataFrame([("1", True)], "run string, collapsed boolean")
    v = {r.run: r.verdict for r in A.sweep_verdict(d, c).collect()}
    assert v == {"0": "FAIL", "1": "FAIL", "2": "WARN", "3": "FAIL", "4": "WARN", "5": "FAIL"}
    profile = spark.createDataFrame([("1", "lb", 0.5), ("2", "lb", 0.99), ("2", "ve", 0.97), ("0", "lb", 0.1), ("3", "lb", 1.0)], "run string, component string, mean_cka double")
    t = {r.run: r.diagnosis for r in A.audit_taxonomy(d, profile).collect()}
    assert t == {"0": "destructive_collapse", "1": "candidate_partial_forgetting", "2": "under_forgetting", "3": "unclassified"}


def test_behaviour_table_and_best(spark):
    p = spark.createDataFrame([("a", "forget", True), ("a", "retain", False), ("b", "forget", False)], "run string, split string, correct boolean")
    t = {r.run: r for r in A.behaviour_table(p).collect()}
    assert (t["a"].forget_acc, t["a"].retain_acc, t["b"].retain_acc, t["b"].retain_n) == (1.0, 0.0, None, 0)
    best = A.best_config(A.behaviour_table(p)).first()
    assert (best.run, best.label) == ("b", "retain_damaged")


def test_control_gate(spark):
    modes = [("correct", True), ("mismatched", False), ("blank", False)]
    rows = [(r, s, m, c) for r in ("ok", "dead") for s in ("forget", "retain") for m, c in modes] + [("leaky", s, m, True) for s in ("forget", "retain") for m, _ in modes]
    p = spark.createDataFrame(rows, "run string, split string, mode string, correct boolean")
    h = spark.createDataFrame([("ok", True), ("leaky", True), ("dead", False)], "run string, trained boolean")
    assert {r.run: r["pass"] for r in A.control_gate(p, h).collect()} == {"ok": True, "leaky": False, "dead": False}


def test_likelihood(spark):
    t = spark.createDataFrame([("b", 1, 0, -1.0, False, 9), ("b", 1, 1, -2.0, True, 5), ("b", 1, 2, -4.0, True, 1), ("m", 1, 1, -1.0, True, 3), ("m", 2, 0, -1.0, False, 1)], "run string, item_id int, pos int, logprob double, supervised boolean, rank int")
    i = {(r.run, r.item_id): r for r in L.item_likelihood(t).collect()}
    assert i["b", 1].nll == 3.0 and i["b", 1].mean_logprob == pytest.approx(-3.0) and i["m", 2].nll is None and i["m", 2].mean_logprob == 0.0
    s = {r.run: r for r in L.likelihood_summary(t, "b").collect()}
    assert s["b"].mean_first_rank == 5 and s["m"].backfire and s["m"].delta_nll == -2.0
    big = spark.createDataFrame([("b", 1, 0.0), ("m", 1, 1e5)], "run string, item_id int, mean_logprob double")
    assert L.preference_loss(big, "b", 1.0).first().loss == pytest.approx(1e5)
    seq = spark.createDataFrame([(1, list("abcab"), list("ab"), 1), (2, list("abc"), list("x"), 9), (3, list("ab"), [], 1)], "item_id int, tokens array<string>, answer_tokens array<string>, prompt_len int")
    assert {r.item_id: (r.start, r.n_supervised) for r in L.answer_span(seq).collect()} == {1: (3, 2), 2: (2, 1), 3: (1, 1)}


def test_cnis_macro_and_micro_differ(spark):
    p = spark.createDataFrame([("e", "r1", 1.0), ("e", "r2", 0.0), ("e", "r2", 0.0), ("f", "r1", None)], "entity string, relation string, leakage double")
    c = {r.entity: r for r in N.cnis(p).collect()}
    assert c["e"].cnis_macro == 0.5 and c["e"].cnis_micro == pytest.approx(2 / 3) and "f" not in c
    assert N.cnis(p, {"r1": 3.0}).first().cnis_macro == pytest.approx(0.25)
    s = N.cnis_summary(spark.createDataFrame([(1.0,), (0.0,), (None,)], "cnis_macro double")).first()
    assert (s.std, s.n) == (0.5, 2)


def test_correlation_status(spark):
    rows = [("few", 1.0, 1.0), ("few", 2.0, 2.0)] + [("flat", 1.0, float(i)) for i in range(4)] + [("ok", float(i), float(i * i)) for i in range(5)]
    got = {r.g: r for r in K.correlate(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    assert {g: r.status for g, r in got.items()} == {"few": "insufficient data", "flat": "constant input", "ok": "ok"}
    assert got["ok"].spearman_r == pytest.approx(1.0) and got["ok"].spearman_p == pytest.approx(0.0) and got["flat"].pearson_r is None


def test_ci_audit_branches(spark):
    vals = [float(i) for i in range(11)]
    runs = ["good", "outside", "off", "count", "nan", "unit", "unpaired"]
    reps = spark.createDataFrame([(r, i, float("nan") if r == "nan" and i == 0 else v) for r in runs for i, v in enumerate(vals)], "run string, replicate int, value double")
    row = lambda r: (r, 99.0 if r == "outside" else 5.0, 0.25 + (1e-6 if r == "off" else 0), 9.75, 12 if r == "count" else 11, "entities" if r == "unit" else "examples", r != "unpaired")
    stored = spark.createDataFrame([row(r) for r in [*runs, "missing"]], "run string, point double, lo double, hi double, n_bootstrap int, unit string, paired boolean")
    got = {r.run: r for r in B.ci_audit(reps, stored, ["run"]).collect()}
    assert {k: v.verdict for k, v in got.items()} == {"good": "PASS", "outside": "WARN", **{k: "FAIL" for k in ("off", "count", "nan", "unit", "unpaired", "missing")}}
    assert got["good"].basic_lo == 0.25 and got["good"].sd == pytest.approx(3.3166247)


def test_value_bootstrap_needs_four(spark):
    v = spark.createDataFrame([("a", i, float(i)) for i in range(5)] + [("b", i, 1.0) for i in range(3)] + [("a", 9, None)], "run string, entity int, v double")
    got = {r.run: r for r in B.value_bootstrap(v, "entity", "v", 30, by=["run"]).collect()}
    assert set(got) == {"a"} and 0 <= got["a"].lo <= got["a"].hi <= 4


def test_overlap_is_symmetric_with_unit_diagonal(spark):
    p = spark.createDataFrame([("a", "i", "X!"), ("b", "i", "x"), ("a", "j", "y"), ("b", "j", "z")], "run string, item_key string, response string")
    o = J.response_overlap(p)
    assert {(r.run_a, r.run_b): r.overlap for r in o.collect()} == {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): 0.5, ("b", "a"): 0.5}
    table = spark.createDataFrame([(0.5,), (1.5,)], "acc double")
    v = {r.check: r.verdict for r in Q.range_checks(table, ["acc"], o, {"acc": 1.0}).collect()}
    assert v["rates in range"] == "FAIL" and v["acc spread"] == "PASS" and v["overlap symmetric"] == "PASS"


def test_answers_in_corpus_by_brute_force(spark):
    answers = ["a", "of", "blue bird", "the blue bird sings", "ird sin", "xyz", "", "one two three four", "wo thre", "ee fo"]
    texts = ["The blue bird sings.", "blue-bird!", "None two three fourth", "of", "", "xy z the blue bird si"]
    a = spark.createDataFrame(list(enumerate(answers)), "answer_id int, answer string")
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    import re

    norm = lambda s: " ".join(re.sub("[^a-z0-9]", " ", s.lower()).split())
    want = {(i, j) for i, x in enumerate(answers) for j, y in enumerate(texts) if norm(x) and norm(x) in norm(y)}
    assert {tuple(r) for r in J.answers_in_corpus(a, t).collect()} == want


def test_long_answers_in_corpus_at_every_place(spark, monkeypatch):
    """Long answers at each offset of the text's blocks, repeated signs included; texts list few entries."""
    import random

    from remnant.functions import text as T

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    answers = [word(62), word(63), word(64), word(150), "a" * 63, "ab" * 40]
    texts = [word(k) + x + word(k % 7) for k in range(40) for x in answers]
    texts += [x[:-1] + "z" for x in answers] + ["a" * 62, "a" * 200, "ba" * 60, ""]
    a = spark.createDataFrame(list(enumerate(answers)), "answer_id int, answer string")
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    want = sorted((i, j) for i, x in enumerate(answers) for j, y in enumerate(texts) if x in y)
    stored, plain = [], J.materialize
    monkeypatch.setattr(J, "materialize", lambda df: stored.append(df) or plain(df))
    assert sorted(tuple(r) for r in J.answers_in_corpus(a, t, T.norm_compact).collect()) == want
    assert len(stored) == 2  # blocks of 32 for five answers, n-grams for the one of 62 characters
