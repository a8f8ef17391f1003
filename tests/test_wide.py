"""CKA through column tiles against moments, at three widths, and with bounded memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from remnant.operators import similarity as C
from remnant.operators.wide import tiled_cka


def pairs(spark, n, p, q, seed=0, layer=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + 3
    y = x[:, :1] * rng.normal(size=(1, q)) + rng.normal(size=(n, q)) - 5
    rows = [("r", "c", layer, i, "e", "forget", a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "run string, component string, layer int, item_id bigint, entity string, split string, x array<double>, y array<double>")


@pytest.mark.parametrize("n,p,q,tile,block_bytes", [(40, 5, 5, 2, 1 << 30), (40, 33, 20, 16, 4000), (30, 130, 64, 64, 20_000), (3, 4, 4, 3, 100)])
def test_tiles_equal_moments(spark, n, p, q, tile, block_bytes):
    rows = pairs(spark, n, p, q).unionByName(pairs(spark, n + 9, q, p, 1, None))
    got = {r["layer"]: r for r in tiled_cka(rows, C.PROFILE, tile=tile, block_bytes=block_bytes).collect()}
    for kind in ("biased", "debiased"):
        want = {r["layer"]: r for r in C.cka(rows, kind=kind).collect()}
        assert set(got) == set(want) == {1, None}
        for k, w in want.items():
            assert got[k]["n"] == w["n"]
            assert (got[k][kind] is None) == (w["cka"] is None) and (w["cka"] is None or abs(got[k][kind] - w["cka"]) < 1e-9)


def test_profile_takes_tiles(spark):
    rows = pairs(spark, 20, 6, 6)
    a, b = C.component_profile(rows).first(), C.component_profile(rows, tile=4).first()
    assert abs(a["cka"] - b["cka"]) < 1e-9
    assert tiled_cka(rows.limit(0), C.PROFILE).count() == 0


def test_uneven_vectors_are_refused(spark):
    rows = pairs(spark, 5, 6, 6).unionByName(pairs(spark, 5, 7, 7))
    with pytest.raises(Exception):
        tiled_cka(rows, C.PROFILE).collect()


def test_width_of_a_layer(spark):
    """4,096 x 4,096 units: the moments of one group would hold 400 MB, tiles half a megabyte."""
    rows = spark.range(60).select(
        F.lit("r").alias("run"), F.lit("c").alias("component"), F.lit(0).alias("layer"), F.col("id").alias("item_id"),
        F.transform(F.sequence(F.lit(1), F.lit(4096)), lambda j: F.pmod(F.hash(F.col("id"), j), F.lit(1000)) / 1000.0).alias("x"),
    ).withColumn("y", F.transform("x", lambda v, j: v * v * (j % 7)))
    found = rows.orderBy("item_id").select("x", "y").collect()
    x, y = (np.array([r[c] for r in found]) for c in ("x", "y"))
    k, l = ((m - m.mean(0)) @ (m - m.mean(0)).T for m in (x, y))
    want = (k * l).sum() / np.sqrt((k * k).sum() * (l * l).sum())
    for block_bytes in (1 << 30, 2 << 20):  # one block, and several
        got = tiled_cka(rows, C.PROFILE, block_bytes=block_bytes).first()
        assert got["n"] == 60 and abs(got["biased"] - want) < 1e-9 and 0 <= got["debiased"] <= 1
