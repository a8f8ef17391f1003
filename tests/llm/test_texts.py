"""Token counts, sampled pieces, quality rules and classifier, toxicity against brute force."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from remnant.llm import quality_classifier as Q
from remnant.llm import quality_rules as R
from remnant.llm import sentencepiece_codec as P
from remnant.llm import token_counts as C
from remnant.llm import toxicity as X

TEXTS = [None, "", " ", "\n", "a", "Hello  world\nsecond line é▁x\n\n", "naïve 😀 Ж▁▁ \t tab\r\n", "ab " * 3000, "x" * 5000, "ж" * 3000, " " * 5000, "中文文本没有空格" * 50, "\ue000\x00 end"]


def brute_counts(text, rule):
    enc, _ = C.encoding()
    data, spans, at = text.encode(), [], 0
    of = [i for i, c in enumerate(text) for _ in c.encode()]
    for t in enc.encode_ordinary(text):
        size = len(enc.decode_single_token_bytes(t))
        spans.append((of[at], of[at + size - 1] + 1))
        at += size
    assert at == len(data)
    lines, start = [], 0
    for line in text.split("\n"):
        lines.append((start, min(start + len(line) + 1, len(text))))
        start += len(line) + 1
    n = [0] * len(lines)
    for s, e in spans:
        share = [min(e, h) - max(s, lo) for lo, h in lines]
        hit = [k for k, v in enumerate(share) if v > 0]
        n[max(hit, key=lambda k: (share[k], -k)) if rule == "largest" else hit[0] if rule == "first" else hit[-1]] += 1
    return n


@pytest.mark.parametrize("rule", C.RULES)
def test_line_counts(spark, rule):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("section", F.lit("clash"))
    got = {}
    for r in C.count_tokens(docs, rule=rule).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append(r["n_tokens"])
        assert r["n_outside"] == 0
    assert got == {i: brute_counts(t or "", rule) for i, t in enumerate(TEXTS)}
    assert C.count_tokens(docs.limit(0)).count() == 0


def test_given_sections(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, "none"), (None, "x")], "doc_id bigint, text string")
    sections = spark.createDataFrame([(1, 7, 0, 5), (1, 8, 3, 11), (1, 9, 11, 11), (1, None, 0, 3), (None, 1, 0, 2)], "doc_id bigint, section bigint, start bigint, end bigint")
    rows = C.count_tokens(docs, sections).collect()
    assert len(rows) == 6 and {r["section"] for r in rows} == {7, 8, 9}
    assert {(r["start"], r["end"]) for r in rows} == {(0, 5), (5, 11), (11, 11)}
    enc, _ = C.encoding()
    total = len(enc.encode_ordinary("alpha beta gamma"))
    assert sum(r["n_tokens"] for r in rows) == 2 * (total - rows[0]["n_outside"])


def test_pieces_round_trip_and_repeat(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "a null key")], "doc_id bigint, text string")
    rows = docs.withColumn("p", P.encode(F.col("text"), F.col("doc_id")))
    got = rows.withColumn("back", P.decode(F.col("p"))).orderBy("doc_id", "text").collect()
    assert all(r["back"] == r["text"] for r in got)
    checked = docs.select("doc_id", P.encode_checked(F.col("text"), F.col("doc_id")).alias("s")).select("doc_id", "s.*")
    assert checked.filter("not lossless").count() == 0
    assert sorted(map(str, checked.select("doc_id", "pieces").collect())) == sorted(str(r) for r in rows.select("doc_id", F.col("p").alias("pieces")).collect())
    again = rows.repartition(3).orderBy("doc_id", "text").collect()
    assert [r["p"] for r in again] == [r["p"] for r in got]
    other = docs.select(P.encode(F.lit("ab " * 300), F.col("doc_id")).alias("p")).distinct().count()
    assert other > 5


def test_samples_follow_the_lattice():
    p = P.pieces()
    units = ["the"]
    keys = np.arange(20_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = P.sample(units * len(keys), keys, p)
    found = {}
    for g in got:
        found[tuple(g)] = found.get(tuple(g), 0) + 1
    paths = {}

    def walk(at, ids, w):
        if at == 3:
            paths[ids] = w
            return
        for k in range(1, 4 - at):
            h = P._hash_strings(["the"[at : at + k]], k)[0]
            i = np.searchsorted(p.keys[k], h)
            if i < len(p.keys[k]) and p.keys[k][i] == h and p.ids[k][i] >= 0:
                walk(at + k, (*ids, int(p.ids[k][i])), w + math.log(p.weight[p.ids[k][i]]))

    walk(0, (), 0.0)
    total = math.fsum(math.exp(w) for w in paths.values())
    assert set(found) <= set(paths)
    for ids, w in paths.items():
        want = math.exp(w) / total
        assert abs(found.get(ids, 0) / len(keys) - want) < 5 * math.sqrt(want / len(keys)) + 1e-4


def brute_stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, marked = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for spots in seen.values():
        if len(spots) > 1:
            marked |= {i + k for i in spots for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_statistics(spark):
    rng = np.random.default_rng(4)
    texts = TEXTS + [" ".join(rng.choice(list("abc"), 200)) for _ in range(5)] + ["one two three four five six seven eight nine\n" * 3, "#$ |\n#$ |\n\n\n x\u00a0y"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", R.statistics(F.col("t")).alias("s")).orderBy("i").collect()
    assert [tuple(r["s"][:5]) for r in got] == [brute_stats(t) for t in texts]


def corpus(spark, n=600):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choice(vocabulary, int(rng.integers(30, 90))).tolist()
        bad = i % 5 == 0
        if bad:
            w = [x + "!!" for x in w] if i % 2 else [x for x in w[:12] for _ in range(5)]
        rows.append((i, " ".join(w), "x", 1.0))
        labels.append((i, int(not bad)))
    rows += [(n, None, "x", 1.0), (n + 1, "", "x", 1.0), (None, "w1 w2 w3 " * 9, None, None), (1, rows[1][1], "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, s string, y double")
    return docs, spark.createDataFrame(labels + [(None, 1), (3, None), (4, 7)], "doc_id bigint, quality int")


def test_rules_learn(spark):
    docs, labels = corpus(spark)
    rows, rules = R.judge(docs, labels)
    got = {r["doc_id"]: r["kept"] for r in rows.collect()}
    assert rules and rows.count() == docs.count()
    right = sum(got[i] == (i % 5 != 0) for i in range(600))
    assert right >= 590 and not got[600] and not got[601]
    kept = R.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == rows.filter("kept").count()
    assert R.explain(rules) and R.judge(docs, labels.limit(0))[1] == []
    assert R.judge(docs.limit(0), labels)[0].count() == 0


def test_rule_order_matches_expression(spark):
    rng = np.random.default_rng(1)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["a"] < 0.3))
    rules = R.learn(x, bad)
    want = np.zeros(900, int)
    for k in range(len(rules), 0, -1):
        want[R._holds(rules[k - 1], x)] = k
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x["a"], x["b"]))], "i int, a double, b double")
    got = df.select("i", R.expression(rules, {"a": F.col("a"), "b": F.col("b")}).alias("r")).orderBy("i").collect()
    assert [r["r"] or 0 for r in got] == want.tolist()
    assert ((want > 0) == bad).mean() > 0.95


def test_classifier(spark):
    docs, labels = corpus(spark)
    rows, weight, least = Q.resample(docs, labels, buckets=4096)
    got = {r["doc_id"]: r for r in rows.collect()}
    assert rows.count() == docs.count()
    assert sum(got[i]["kept"] == (i % 5 != 0) for i in range(600)) >= 590
    assert not got[600]["kept"] and not got[601]["kept"] and got[600]["importance"] is None
    b = Q.grams("w1 w2 w3", 4096)
    assert len(b) == 5 and got[7]["n_grams"] == 2 * len(docs.filter("doc_id = 7").first()["text"].split()) - 1
    text = docs.filter("doc_id = 7").first()["text"]
    assert got[7]["importance"] == pytest.approx(np.mean(weight.astype(np.float32)[Q.grams(text, 4096)].astype(float)))
    keys = sorted((r["key"] for r in got.values() if r["key"] is not None), reverse=True)
    assert least in keys
    kept = Q.keep_sampled(docs, labels, buckets=4096)
    assert kept.columns == docs.columns and kept.count() == rows.filter("kept").count()
    assert Q.resample(docs.limit(0), labels)[0].count() == 0
    assert Q.resample(docs, labels.limit(0))[0].filter("kept").count() == docs.count() - 2


def test_cut_is_chosen_on_unseen_documents(spark):
    # Every text has words of its own, so that good documents of the fit look better than others.
    rng = np.random.default_rng(12)
    rows, labels = [], []
    for i in range(800):
        bad = i % 4 == 0
        w = rng.choice([f"{'b' if bad else 'g'}{k}" for k in range(60)], 12).tolist() + rng.choice([f"c{k}" for k in range(60)], 20).tolist() + [f"own{i}x{k}" for k in range(30)]
        rows.append((i, " ".join(rng.permutation(w))))
        if i < 300:
            labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = Q.resample(docs, labels)[0].toPandas().set_index("doc_id")
    unseen = [i for i in range(300, 800) if i % 4]
    assert got.loc[unseen, "kept"].mean() > 0.97
    assert got.loc[[i for i in range(300, 800) if i % 4 == 0], "kept"].mean() < 0.03
    fitted, held = Q.split_good(np.arange(101))
    assert not set(fitted) & set(held) and sorted([*fitted, *held]) == list(range(101)) and len(held) == 21 and len(Q.split_good([4, 9])[0]) == 1


def test_kth_largest(spark):
    v = np.random.default_rng(2).normal(size=30_000).tolist() + [5.0] * 40 + [float("nan")] * 0
    df = spark.createDataFrame([(x,) for x in v], "v double").repartition(5)
    s = sorted(v, reverse=True)
    for k in (1, 20, 41, 5000, 30_040):
        assert Q.kth_largest(df, "v", k) == s[k - 1]
    assert Q.kth_largest(df, "v", 30_041) == float("-inf") and Q.kth_largest(df, "v", 0) == float("inf")


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choice(words, 60).tolist()
        if i % 4 == 0:
            for bad in rng.choice(["vile", "rotten", "foul"], 2):
                w.insert(int(rng.integers(0, 60)), bad)
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(i % 4 == 0)))
    rows += [(400, None, None), (401, "", None), (None, "vile rotten foul", None), (1, rows[1][1], "en"), (402, "w1 " * 50 + "v1le r0tten f-o-u-l " + "w2 " * 50, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame(labels + [(None, 1), (2, None)], "doc_id bigint, toxic int")
    model = X.train(X.labelled(docs, labels, ~X.held_out(F.col("doc_id"))))
    assert set(model[0]) == {"vile", "rotten", "foul"}
    got = {r["doc_id"]: r["score"] for r in X.score(docs, model).collect()}
    assert len(got) == 404 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in range(400)]) > 0.98
    assert X.score(docs.limit(0), model).count() == 0
    assert X.train(X.labelled(docs, labels.limit(0))) is None and X.score(docs, None).filter("score = 0").count() == docs.count()
    f = dict(zip(X.FEATURES, X.features_of("w1 v1le r0tten f-o-u-l l o s e r YOU!!", dict(model[0]) | {"loser": 2.0})))
    assert f["plain_hits"] == 4 and f["capital_rate"] > 0 and f["mark_runs"] > 0 and f["person_rate"] > 0


def test_held_out_is_crc(spark):
    from zlib import crc32

    got = spark.range(50).select("id", X.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
