"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (a hash of the id).  A document's
virtual finish time is the cumulative number of source words up to and with it, divided by the
source's target; a second round over the source goes on where the first ended.  All documents
of all sources are ranked by finish time and the ranking is truncated at the total budget.

Nothing is sorted as a whole.  The shuffle hash cuts each source into about sqrt(rows) even
buckets: bucket totals give offsets, and running sums stay inside a bucket.  Finish times are
cut the same way, so only the bucket that holds the budget is ranked.  Inside a source, the
finish time rises in shuffled order; what is taken is thus a prefix, and one small row per
source (the last document taken in each round) decides every document in place, without moving
texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remnant.llm.common import text_udf, words
from remnant.sources.storage import materialize, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SALT = "mix:"
ROUNDS = 2


def size_of(text: Column) -> Column:
    """Number of words; null texts have none."""
    return text_udf(lambda texts: {"n": [len(words(t)) for t in texts]}, "n bigint")(text.cast("string"))["n"]


def shuffle_key(doc_id: Column) -> Column:
    """32 bits of a hash of the id; a null id counts as an empty one."""
    digest = F.md5(F.concat(F.lit(SALT), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, place, source_size, target from one row per source (source, source_size).

    Targets share `share` of all words by weight and stop at `most` times the source's size;
    the excess goes to the others by weight.  The sources that stop are those with the least
    most * size / weight, so running sums in that order give the level of the rest.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("place", F.row_number().over(order).cast("bigint") - 1)
    rows = rows.withColumn("w", w).withColumn("stop", most * F.col("source_size")).withColumn("ratio", F.col("stop") / F.col("w"))
    rank = Window.partitionBy(F.lit(0)).orderBy("ratio", "place")
    every = Window.partitionBy(F.lit(0))
    rows = (
        rows.withColumn("full", F.coalesce(F.sum("stop").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (share * F.sum("source_size").over(every) - F.col("full")) / F.col("rest"))
    )
    # The first source whose own limit is not below the level: it and all later ones get the level.
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "place", "level"))).over(every)["level"]
    return rows.withColumn("_l", level).select(
        "source", "place", "source_size",
        F.when(F.col("_l").isNull() | (F.col("ratio") < F.col("_l")), F.col("stop")).otherwise(F.col("_l") * F.col("w")).alias("target"),
    )


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source, source_size, target and the last key taken in each round.

    sized: doc_id, source, size.  `last` is an array of ROUNDS structs (h, id, size), null where
    the round takes nothing.  Sources may be null; equal rows are taken together.
    """
    # Equal rows are one row with the sum of their sizes, so that no id (null ones neither) is a hot bucket.
    base = materialize(
        sized.groupBy(
            "source", F.col("size").cast("bigint").alias("size"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        ).agg(F.sum("size").cast("bigint").alias("all")).withColumn("h", shuffle_key(F.col("id")))
    )
    goals, _ = stored(targets(base.groupBy("source").agg(F.sum("all").alias("source_size")), weights, share, most), "targets")
    n, budget = base.count(), goals.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    bits = max(4, math.ceil(math.log2(max(2.0, math.sqrt(n)))))
    rows = base.join(goals, base["source"].eqNullSafe(goals["source"])).select(
        "place", "source_size", "target", "size", "all", "id", "h", F.shiftrightunsigned(F.col("h"), 32 - bits).alias("b")
    )
    ahead = Window.partitionBy("place").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets, _ = stored(
        rows.groupBy("place", "b").agg(F.sum("all").alias("s")).select(
            "place", "b", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("before")
        ),
        "offsets",
    )
    inside = Window.partitionBy("place", "b").orderBy("h", "id", "size")
    timed = rows.join(offsets, ["place", "b"]).withColumn("cum", F.col("before") + F.sum("all").over(inside))
    timed = materialize(
        timed.filter("size > 0").select(
            "place", "h", "id", "size", "all",
            F.posexplode(F.array(*[(F.col("cum") + k * F.col("source_size")) / F.col("target") for k in range(ROUNDS)])).alias("round", "time"),
        )
    )
    scale = 1 << bits
    slot = F.least(F.floor(F.col("time") * scale), F.lit(4 * scale)).cast("bigint")
    binned = timed.withColumn("slot", slot)
    total = Window.partitionBy(F.lit(0)).orderBy("slot")
    cut = (
        binned.groupBy("slot").agg(F.sum("all").alias("s")).withColumn("upto", F.sum("s").over(total))
        .filter(F.col("upto") > budget).agg(F.min(F.struct("slot", "upto", "s")).alias("x")).first()["x"]
    )
    at, before = (cut["slot"], cut["upto"] - cut["s"]) if cut else (8 * scale, 0)
    edge = Window.partitionBy(F.lit(0)).orderBy("time", "place", "h", "id", "size", "round")
    tail = binned.filter(F.col("slot") == at).withColumn("run", F.sum("all").over(edge) + before).filter(F.col("run") <= budget)
    taken = binned.filter(F.col("slot") < at).drop("slot").unionByName(tail.drop("run", "slot"))
    last = taken.groupBy("place").agg(
        F.array(*[F.max(F.when(F.col("round") == k, F.struct("h", "id", "size"))) for k in range(ROUNDS)]).alias("last")
    )
    return goals.join(last, "place", "left").select("source", "source_size", "target", "last")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """docs with _size, _source_size, _target and _taken, the words that the mix takes of a row.

    Documents are taken whole, up to twice.  Null and blank texts have size 0 and take nothing; a
    null source is a source of its own, placed last.  Rows equal in id, source and size are taken
    alike.  Reruns agree, since order depends on ids alone.  Columns of docs with the new names
    are replaced.
    """
    found = _copies(docs, weights, share, most, id_col, text_col, source_col)
    new = ("_size", "_source_size", "_target", "_taken")
    taken = (F.col("copies") * F.col("size")).cast("bigint")
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c not in new]
    return found.select(*kept, F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), taken.alias("_taken"))


def _copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """doc (a row of docs), size, source_size, target and copies, how often the mix takes the row."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    rows = docs.select(
        F.struct("*").alias("doc"), size_of(F.col(text_col)).alias("size"), F.col(source_col).alias("own"),
        shuffle_key(F.col(id_col)).alias("h"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
    )
    goals, _ = stored(plan(sized, weights, share, most), "mix")
    joined = rows.join(goals, F.col("own").eqNullSafe(F.col("source")), "left")
    mine = F.struct("h", "id", "size")
    copies = sum((F.when(mine <= F.col("last")[k], 1).otherwise(0) for k in range(ROUNDS)), F.lit(0))
    copies = F.when(F.col("size") > 0, F.coalesce(copies, F.lit(0))).otherwise(0)
    return joined.select("doc", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with the columns of docs; one taken twice is there twice."""
    found = _copies(docs, **options)
    return found.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("one")).select("doc.*")
