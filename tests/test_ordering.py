"""Positions, neighbours and ranks against plain windows, with one group holding most rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from remnant.operators import alignment as J
from remnant.operators import ordering as O
from remnant.operators import selection as P


@pytest.fixture(scope="module")
def rows(spark):
    g = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
    return spark.range(3000).select(
        "id", g.alias("g"), F.md5(F.col("id").cast("string")).alias("h"), F.format_string("entity_%06d", "id").alias("s"),
        (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 997).cast("double").alias("y"),
    ).cache()


@pytest.fixture
def split(spark):
    """Without merging of small partitions, so that a few rows fill several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def same(a, b):
    key = lambda df: sorted(map(str, (tuple(r) for r in df.select(sorted(df.columns)).collect())))
    assert key(a) == key(b)


@pytest.mark.parametrize("group", [["g"], []])
@pytest.mark.parametrize("order", [["id"], ["h"], ["x", "id"], ["s"]])
def test_positions(rows, split, order, group):
    w = Window.partitionBy(*(group or [F.lit(0)]))
    plain = rows.withColumn("pos", F.row_number().over(w.orderBy(*order)).cast("bigint") - 1).withColumn("n", F.count(F.lit(1)).over(w))
    same(O.with_position(rows, group, order, "pos", "n"), plain)


def test_long_common_prefixes_fill_several_ranges(rows, split):
    ranges = O._ranged(rows.filter("g = 'hot'"), ["g", "s"]).select("_range").distinct().count()
    assert ranges > 1


def test_neighbors_and_ranks(rows, split):
    w = Window.partitionBy("g").orderBy("h", "id")
    whole = Window.partitionBy("g").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same(O.with_neighbor(rows, ["g"], ["h", "id"], {"id": "other"}), rows.withColumn("other", F.coalesce(F.lead("id").over(w), F.first("id").over(whole))))
    same(O.with_neighbor(rows, ["g"], ["h", "id"], {"id": "other"}, -1, False), rows.withColumn("other", F.lag("id").over(w)))
    rank = F.rank().over(Window.partitionBy("g").orderBy("x")) + (F.count(F.lit(1)).over(Window.partitionBy("g", "x")) - 1) / F.lit(2.0)
    same(O.with_average_rank(rows, ["g"], "x", "r"), rows.withColumn("r", rank))


def test_operators_on_ranges(rows, split):
    w = Window.partitionBy("g")
    got = P.hash_shuffle(rows, "id", 42, 1, ["g"])
    assert got.groupBy("g").agg(F.count_distinct("pos").alias("n"), F.max("pos").alias("m"), F.count(F.lit(1)).alias("k")).filter("n <> k or m <> k - 1").isEmpty()
    shuffled = J.shuffled_label_control(rows.withColumn("label", F.col("id")), 42, "g", "id", {"label": "other"})
    assert shuffled.filter("other = id").count() == 0
    assert shuffled.select("other").distinct().count() == rows.count()


def test_partition_count_does_not_matter(rows, spark):
    got = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, O.with_position(rows, ["g"], ["h"]).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_spread_picks(spark):
    q = spark.range(10).select(F.lit("e").alias("entity"), F.lit("q").alias("question"), F.lit("a").alias("answer"), "id")
    pick = lambda k: sorted(r.id for r in P.spread_k_per_entity(q, k, ["id"]).collect())
    assert pick(4) == [0, 3, 6, 9] and pick(1) == [0] and len(pick(0)) == 10 and len(pick(99)) == 10
