"""Embedding near-duplicates by collision-counting projections.

Vectors are scaled to length one and projected on many random lines.  On one line, a pair at
cosine c lies N(0, 2 - 2c) apart, so a window of half-width WIDTH * sqrt(2 - 2 * threshold)
around the query holds a pair at the threshold with a known chance.  Each line is sorted and read
from every query to the end of its window; the collisions are counted per pair over COUNTED
lines, and pairs pass with at most `misses` missing: the least number for which a pair exactly at
the threshold passes with chance RECALL (binomial).  Those that pass are verified by cosine in
double precision.

Narrow windows with many misses beat wide ones with few: at WIDTH 1 a window holds a fifth of
unrelated vectors and one pair in some thousands passes; at 2.4 it holds half.

Cells only bound a scan: `tables` tables each cut `bits` further lines at zero, and
vectors meet in a table when they lie on the same side of all its lines.  bits grows with the
logarithm of the largest label, and the number of tables follows from RECALL at the threshold,
so cells keep their size as data grow.  A pair counts in the first table in which it meets.
Cells that stay large (a dense cluster) are dealt over several tasks by blocks.

Equal vectors are one entry with a count.  Tasks return per vector the number of vectors
linked, and a spanning star of the links, never the pairs.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remnant.llm.common import components, deal_blocks, forest, group_starts, sorted_groups
from remnant.sources.storage import materialize

THRESHOLD = 0.93
RECALL = 0.995
WIDTH = 1.0
COUNTED = 40
CELL = 1024  # vectors that a cell should have
CHUNK = 4096
BLOCK = 512
SEED = 20240


class Design(NamedTuple):
    """Numbers that follow from the threshold, the recall and the size of the largest label."""

    threshold: float
    window: float
    misses: int
    bits: int
    tables: int


def design(largest: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Design:
    """Window, allowed misses and tables for a pair exactly at the threshold.

    The chance of a miss is split evenly between the tables and the count.
    """
    each = math.sqrt(recall)
    apart = math.sqrt(2 - 2 * threshold)
    miss = math.erfc(WIDTH / math.sqrt(2))
    chance, misses = (1 - miss) ** COUNTED, 0
    while chance < each:
        misses += 1
        chance += math.comb(COUNTED, misses) * miss**misses * (1 - miss) ** (COUNTED - misses)
    bits = max(0, math.ceil(math.log2(max(1, largest) / CELL)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    tables = math.ceil(math.log(1 - each) / math.log(1 - meet)) if bits else 1
    return Design(threshold, WIDTH * apart, misses, bits, tables)


def lines(dim: int, d: Design) -> np.ndarray:
    """Random lines: first those of the tables, then those that are counted."""
    return np.random.default_rng([SEED, dim]).standard_normal((d.tables * d.bits + COUNTED, dim))


def scaled(rows: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    v = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top  # so that neither tiny nor huge values lose their squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def table_cells(x: np.ndarray, a: np.ndarray, d: Design) -> np.ndarray:
    """Cell of each vector in each table."""
    side = (x @ a[: d.tables * d.bits].T > 0).reshape(len(x), d.tables, d.bits)
    return side @ (1 << np.arange(d.bits, dtype=np.int64))


def collisions(left: np.ndarray, right: np.ndarray | None, window: float) -> tuple[np.ndarray, int]:
    """Collisions per pair over all lines, and the number of window entries that were read.

    Rows are vectors, columns lines.  Each line is sorted once and read from each vector of
    `left` outwards as far as its window goes; entries outside are never looked at.  Without
    `right`, pairs lie within `left` and count once, for the vector that comes first.
    """
    same = right is None
    right = left if same else right
    counts, read = np.zeros(len(left) * len(right), np.uint8), 0
    for k in range(left.shape[1]):
        order = np.argsort(right[:, k], kind="stable")
        line = right[order, k]
        if same:
            query, at = order, np.arange(1, len(order) + 1)
        else:
            query, at = np.arange(len(left)), np.searchsorted(line, left[:, k] - window, "left")
        wide = np.searchsorted(line, left[query, k] + window, "right") - at
        longest = np.argsort(-wide, kind="stable")  # queries whose windows go on are a prefix
        wide, at, row = wide[longest], at[longest], query[longest] * len(right)
        for step in range(max(0, int(wide[0]))):
            n = int(np.searchsorted(-wide, -step, "left"))
            counts[row[:n] + order[at[:n] + step]] += 1
            read += n
    counts = counts.reshape(len(left), len(right))
    return (np.triu(counts + counts.T, 1) if same else counts), read


def cell_links(x: np.ndarray, cells: np.ndarray, a: np.ndarray, t: int, d: Design, split: int):
    """Linked positions (i, j) among the vectors of one cell of table t.

    split > 0: only pairs with one vector before and one from `split`.
    """
    p = x @ a[d.tables * d.bits :].T
    n, found = len(x), []
    for s in range(0, split or n, BLOCK):
        e = min(s + BLOCK, split or n)
        # Within a block, then the block against all that follows it.
        sides = [(split, n)] if split else [(s, e), (e, n)]
        for rs, re in sides:
            if rs == re:
                continue
            counts, _ = collisions(p[s:e], None if rs == s else p[rs:re], d.window)
            u, v = np.nonzero(counts >= COUNTED - d.misses)
            u, v = u + s, v + rs
            if t:
                first = (cells[u, :t] != cells[v, :t]).all(axis=1)
                u, v = u[first], v[first]
            for c in range(0, len(u), 65_536):
                uu, vv = u[c : c + 65_536], v[c : c + 65_536]
                real = np.einsum("ij,ij->i", x[uu], x[vv]) >= d.threshold
                found.append((uu[real], vv[real]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _cells(d: Design):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                cells = table_cells(scaled(part.column("v"), int(dim)), lines(int(dim), d), d)
                n = part.num_rows
                take = np.repeat(np.arange(n), d.tables)
                out = part.take(pa.array(take)).select(["id", "label", "dim", "n", "v"])
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(np.tile(np.arange(d.tables, dtype=np.int32), n)), pa.array(cells.ravel())],
                    ["id", "label", "dim", "size", "v", "t", "cell"],
                )

    return run


def _links(d: Design):
    key = ["label", "dim", "t", "cell", "lo", "hi"]

    def run(batches):
        for t in sorted_groups(batches, key):
            k = [t.column(c).to_numpy() for c in key]
            ids, size, chunk = (t.column(c).to_numpy() for c in ("id", "size", "chunk"))
            starts = group_starts(k)
            vectors = t.column("v").combine_chunks()
            for g in range(len(starts) - 1):
                s, e = int(starts[g]), int(starts[g + 1])
                if e - s < 2:
                    continue
                dim, lo, hi = int(k[1][s]), k[4][s], k[5][s]
                order = np.argsort(chunk[s:e] != lo, kind="stable")
                split = int((chunk[s:e] == lo).sum()) if lo != hi else 0
                x = scaled(vectors.slice(s, e - s), dim)[order]
                a = lines(dim, d)
                i, j = cell_links(x, table_cells(x, a, d), a, int(k[2][s]), d, split)
                if not len(i):
                    continue
                own, n = ids[s:e][order], size[s:e][order]
                links = np.bincount(i, n[j], e - s) + np.bincount(j, n[i], e - s)
                some = np.flatnonzero(links)
                x, y = forest(own[i], own[j])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([own[some], x]), pa.int64()),
                        pa.array(np.concatenate([np.zeros(len(some), np.int64), y]), pa.int64(), mask=np.arange(len(some) + len(x)) < len(some)),
                        pa.array(np.concatenate([links[some], np.zeros(len(x))]).astype(np.int64), pa.int64()),
                    ],
                    ["a", "b", "n"],
                )

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", chunk: int = CHUNK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors.

    Vectors with equal labels (of any type) and as many components link at cosine >= threshold.  A vector that
    is null, empty or zero, or has null, NaN or infinite components, or has a null label or a
    null id, links with nothing.  Rows that repeat an id are vectors of their own, except that
    n_links and component_id speak of ids.  Other columns are ignored.
    """
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    zero = ~F.exists(v, lambda c: c != 0)
    valid = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & ~zero
    # Two 64-bit hashes of label and vector stand for them, so that vectors move once per class.
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.xxhash64(F.lit(3), F.col(label_col)).alias("label"), v.alias("v"),
        F.when(F.coalesce(valid, F.lit(False)), F.xxhash64(F.lit(1), F.col(label_col), v)).alias("k1"),
        F.when(F.coalesce(valid, F.lit(False)), F.xxhash64(F.lit(2), F.col(label_col), v)).alias("k2"),
    )
    classes = materialize(
        rows.filter("k1 is not null").groupBy("k1", "k2").agg(
            F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v")
        ).withColumn("dim", F.size("v"))
    )
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    d = design(largest, threshold, recall)
    schema = "id bigint, label bigint, dim int, size bigint, v array<double>, t int, cell bigint"
    cells = classes.select("id", "label", "dim", "n", "v").mapInArrow(_cells(d), schema)
    key = ["label", "dim", "t", "cell"]
    dealt = deal_blocks(cells, key, F.col("id"), chunk)
    key = [*key, "lo", "hi"]
    found = materialize(
        dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_links(d), "a bigint, b bigint, n bigint")
    )
    merged = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("far"))
    final = (
        classes.select("k1", "k2", "id", "n")
        .join(counts.withColumnRenamed("a", "id"), "id", "left")
        .join(merged.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "k1", "k2", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    out = rows.select("vec_id", "k1", "k2").join(final, ["k1", "k2"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )
