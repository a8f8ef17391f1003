"""Near-duplicate operators against brute force, with hot groups, nulls and odd tables."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from remnant.llm import embedding_dedup as E
from remnant.llm import simhash_dedup as S
from remnant.llm.common import components, forest


def smallest(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_long_chain(spark):
    n = 24
    order = np.random.default_rng(1).permutation(n).tolist()
    rows = [(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(components(spark.createDataFrame(rows, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(n)} | {100: 100, 101: 100}


def test_forest_keeps_components():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    x, y = forest(a, b)
    assert smallest(200, zip(a, b)) == smallest(200, zip(x, y)) and len(x) < 200


def brute_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "a", "A b", "one two three", "Ünï ÇA x\u00a0y z\x1c q", "x y z " * 500, "ab" * 50_000])
def test_fingerprint(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(S.fingerprint(F.col("t"))).first()[0]
    assert got % (1 << 64) == brute_fingerprint(text)


def test_hash_is_sparks(spark):
    got = spark.createDataFrame([("ä b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("ä b c".encode(), 42)


def bits(rng, base, k):
    for b in rng.choice(64, k, replace=False):
        base ^= 1 << int(b)
    return base


@pytest.mark.parametrize("chunk", [8192, 16])
def test_links_match_brute_force(spark, chunk):
    rng = np.random.default_rng(5)
    hub = int(rng.integers(0, 1 << 62))
    values = [int(rng.integers(0, 1 << 63)) for _ in range(60)] + [0, (1 << 64) - 1]
    values += [bits(rng, v, int(rng.integers(1, 5))) for v in values[:40]]
    values += [bits(rng, hub, int(rng.integers(0, 4))) for _ in range(90)]
    values = list(dict.fromkeys(values))
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    found = S.links(spark.createDataFrame(rows, "id bigint, fp bigint"), chunk).collect()
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    assert all((values[a] ^ values[b]).bit_count() <= 2 for a, b in found) or smallest(len(values), found)
    assert smallest(len(values), found) == smallest(len(values), pairs)


def test_tree_prunes_and_loses_nothing():
    rng = np.random.default_rng(8)
    v = [bits(rng, 0x0123456789ABCDEF, int(rng.integers(0, 9))) for _ in range(300)]
    fp = np.unique(np.array(v, np.uint64))
    fp = fp[np.argsort(S.gray_rank(fp))]
    i, j = S.tree_links(fp)
    pairs = [(a, b) for a in range(len(fp)) for b in range(a) if int(fp[a] ^ fp[b]).bit_count() <= 2]
    assert smallest(len(fp), zip(i, j)) == smallest(len(fp), pairs)


def test_simhash_rows(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long, "x"), (3, long + " tail", "x"), (3, long + " tail", "x"), (9, "other text here", None), (None, "other text here", None), (8, None, None), (7, "", None), (None, "nobody has this", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = {(r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs).collect()}
    near = (S.fingerprint_words(long.encode().split()) ^ S.fingerprint_words((long + " tail").encode().split())) % (1 << 64)
    assert S.near_duplicates(docs).count() == len(rows)
    assert {(9, 9), (None, 9), (8, 7), (7, 7), (None, None), (3, 3)} <= got
    assert ((5, 3) in got) == (near.bit_count() <= 2)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted([-1, -1, 3, 7, 9] + ([] if (5, 3) in got else [5]))
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_shared_ids_join_nothing(spark):
    rng = np.random.default_rng(21)
    a, b, c = (" ".join(rng.choice([f"{k}{i}" for i in range(200)], 60)) for k in "abc")
    rows = [(5, a, 1), (5, b, 2), (9, b, 3), (None, c, 4), (None, c, 5), (7, a, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in S.keep_one(docs).collect())
    assert kept == sorted([(5, a), (5, b), (-1, c)])
    many = spark.createDataFrame([(1, " ".join(f"x{i}y{k}" for k in range(20)), i) for i in range(40)], "doc_id bigint, text string, n int")
    assert S.keep_one(many).count() == 40
    got = {(r["doc_id"], r["fp"]) : r["component_id"] for r in S.near_duplicates(docs).collect()}
    assert {v for (i, _), v in got.items() if i is not None} == {5}


def brute_vectors(rows, threshold=0.93):
    ok = [v is not None and lab is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, lab in rows]
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    pairs.append((i, j))
    return pairs


@pytest.mark.parametrize("chunk", [4096, 8])
def test_vectors_match_brute_force(spark, chunk):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        v = rng.standard_normal(16)
        rows.append((len(rows), v.tolist(), i % 3))
        for _ in range(int(rng.integers(0, 4))):
            rows.append((len(rows), (v * 3 + rng.standard_normal(16) * rng.uniform(0, 1.2)).tolist(), i % 3))
    rows += [(len(rows) + k, rows[4][1], rows[4][2]) for k in range(12)]
    rows = [(i, [float(np.float32(c)) for c in v], lab) for i, (_, v, lab) in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [None] + rows[0][1][1:], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0), (n + 8, [float("inf"), 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("n", F.lit("clash")).withColumn("cell", F.lit(1))
    got = {r["vec_id"]: r for r in E.near_duplicates(df, chunk=chunk).collect()}
    pairs = brute_vectors(rows)
    root = smallest(len(rows), pairs)
    links = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    assert [got[i]["component_id"] for i in range(len(rows))] == root
    assert [got[i]["n_links"] for i in range(len(rows))] == links.tolist()
    assert all(got[i]["kept"] == (root[i] == i) for i in range(len(rows)))
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_design_reaches_recall():
    for largest in (10, 5_000, 10_000_000):
        d = E.design(largest)
        rng = np.random.default_rng(2)
        x = rng.standard_normal((600, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        o = rng.standard_normal((600, 64))
        o -= (o * x).sum(axis=1, keepdims=True) * x
        o /= np.linalg.norm(o, axis=1, keepdims=True)
        y = 0.9301 * x + np.sqrt(1 - 0.9301**2) * o
        a = E.lines(64, d)
        both = np.concatenate([x, y])
        cells = E.table_cells(both, a, d)
        meet = (cells[:600] == cells[600:]).any(axis=1)
        p = both @ a[d.tables * d.bits :].T
        passed = (np.abs(p[:600] - p[600:]) > d.window).sum(axis=1) <= d.misses
        assert (meet & passed).mean() > 0.98


def test_windows_are_scanned_not_all_pairs():
    """Counts equal brute force, and only window entries are read: a fifth of all pairs a line."""
    d = E.design(10)
    x = np.random.default_rng(5).standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = x @ E.lines(64, d).T[:, d.tables * d.bits :]
    near = (np.abs(p[:, None, :] - p[None, :, :]) <= d.window).sum(axis=2)
    counts, read = E.collisions(p, None, d.window)
    assert (counts == np.triu(near, 1)).all()
    assert read == np.triu(near, 1).sum() < 0.25 * E.COUNTED * 400 * 399 / 2
    counts, read = E.collisions(p[:150], p[150:], d.window)
    assert (counts == near[:150, 150:]).all() and read == near[:150, 150:].sum()
    assert (near >= E.COUNTED - d.misses)[np.triu_indices(400, 1)].mean() < 0.005


def test_links_of_a_cell_reach_recall():
    """Pairs around the threshold in one cell, also where the cell is dealt in two parts."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[750:] = x[:750] + rng.uniform(0.2, 0.4, (750, 1)) / 8 * rng.standard_normal((750, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(1500)]
    d = E.design(1000)
    a = E.lines(64, d)
    true = set(zip(*np.nonzero(np.triu(x @ x.T >= d.threshold, 1))))
    for split, wanted in ((0, true), (700, {(i, j) for i, j in true if i < 700 <= j})):
        found = set(zip(*E.cell_links(x, E.table_cells(x, a, d), a, 0, d, split)))
        assert found <= wanted and len(found) >= 0.99 * len(wanted) > 0
