"""Shared helpers: texts in slices inside tasks, whole-number summaries, graph components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from remnant.sources.storage import discard, stored

#: Words are runs of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SLICE = 256  # texts turned into Python objects at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() cuts at exactly those six characters.

    lower: A-Z become a-z, other letters stay.
    """
    if not text:
        return []
    data = text.encode("utf-8", "replace")
    return (data.lower() if lower else data).split()


def text_udf(fn: Callable[[list], dict], ddl: str):
    """Arrow UDF of one text column: `fn` maps a list of texts to columns of a struct."""
    kind = T._parse_datatype_string(ddl)
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in kind.fields]

    @arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, len(texts), SLICE):
            got = fn(texts.slice(start, SLICE).to_pylist())
            parts.append(
                pa.StructArray.from_arrays(
                    [pa.array(got[f.name], type=f.type) for f in fields], fields=fields
                )
            )
        return pa.concat_arrays(parts) if parts else pa.array([], type=pa.struct(fields))

    return run


def sorted_groups(
    batches: Iterator[pa.RecordBatch], key: list[str]
) -> Iterator[dict[str, pa.Array]]:
    """Whole groups from batches sorted by `key`: as many complete groups as each batch ends.

    A task holds one batch and the open group, never its whole partition.
    """
    carry = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if carry is not None:
            t = pa.concat_tables([carry, t])
        n = t.num_rows
        if not n:
            continue
        open_rows = np.ones(n, bool)
        for k in key:
            c = t.column(k).to_numpy()
            open_rows &= c == c[-1]
        at = n - int(np.argmin(open_rows[::-1])) if not open_rows.all() else 0
        carry = t.slice(at).combine_chunks()
        if at:
            yield t.slice(0, at)
    if carry is not None and carry.num_rows:
        yield carry


def deal_blocks(rows: DataFrame, key: list[str], by: Column, chunk: int) -> DataFrame:
    """rows with chunk, lo, hi: a group of more than `chunk` rows becomes several blocks.

    Rows are dealt evenly to n = ceil(size / chunk) chunks by a hash of `by`; block (lo, hi)
    gets the rows of both chunks, so that any two rows of a group meet in exactly one block
    of different chunks, or in the block of their own.  Groups that fit are one block (0, 0).
    """
    large = (
        rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk)
        .select(*key, F.ceil(F.col("_n") / chunk).cast("int").alias("_n"))
    )
    dealt = rows.join(large, key, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(by), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumn("lo", F.least("chunk", "_o")).withColumn("hi", F.greatest("chunk", "_o")).drop("_n", "_o")


def group_starts(keys: list[np.ndarray]) -> np.ndarray:
    """Start of each run of equal keys, and the end of all."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star per component of the given edges: (member, smallest id) without loops."""
    if not len(a):
        return a[:0], b[:0]
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all() and (root[x] == root[y]).all():
            break
    other = root != np.arange(len(ids))
    return ids[other], ids[root[other]]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes with an edge.

    edges: long columns a, b; rows may repeat, loops are ignored.  Each round takes the least
    label of the neighbours and then that label's own label, so the rounds grow with the
    logarithm of the longest path.  Labels stay distributed; every round is
    written to the shared folder.
    """
    spark = edges.sparkSession
    pairs = edges.filter("a <> b")
    both, edge_path = stored(
        pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels, path = stored(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"), F.lit(True).alias("moved")), "labels"
    )
    while not labels.filter("moved").isEmpty():
        known = labels.select("node", "component")
        near = (
            both.join(known, F.col("b") == F.col("node"))
            .groupBy("a").agg(F.min("component").alias("m"))
        )
        far = near.join(known.select(F.col("node").alias("m"), F.col("component").alias("m2")), "m").select(
            F.col("a").alias("node"), F.least("m", "m2").alias("m")
        )
        old = path
        labels, path = stored(
            known.join(far, "node").select(
                "node", F.least("component", "m").alias("component"), (F.col("m") < F.col("component")).alias("moved")
            ),
            "labels",
        )
        discard(spark, old)
    discard(spark, edge_path)
    return labels.select("node", "component")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def bounded_labels(
    labels: DataFrame, column: str, bound: int, seed: int, where: Column | None = None
) -> DataFrame:
    """(doc_id, y): one 0/1 label per document, about `bound` of them at most.

    Null ids, null labels and labels other than 0 and 1 are ignored; of contrary labels the
    larger counts.  Above the bound, documents are drawn by a hash of their id.
    """
    y = F.col(column).cast("int")
    rows = labels.filter(F.col("doc_id").isNotNull() & y.isin(0, 1))
    if where is not None:
        rows = rows.filter(where)
    one = rows.groupBy("doc_id").agg(F.max(y).alias("y"))
    rate = min(1.0, bound / max(1, one.count()))
    return one if rate == 1.0 else one.filter(uniform(seed, F.col("doc_id")) < rate)
