"""Linear CKA of wide vectors: products of tall matrices, tile by tile.

Moments hold the square of the width per group, too much for layers of thousands of units.  Here
a group's rows are dealt to blocks of a bounded number of bytes.  A task centres one block and
multiplies its column tiles two by two.  A group of one block gives only the squared sums of its
tiles; in groups of several blocks each task sends one tile at a time, tiles of the same place are
added up across blocks as a stream, and each sum gives its squared sum.  A task holds one block and
one tile, whatever the width and the number of rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TILE = 256
BLOCK_BYTES = 128 << 20

#: Sums of a group: rows, squared norms of both sides, their products, and squared tile sums.
SUMS = ("n", "k", "l", "kl", "kk", "ll", "fxy", "fxx", "fyy")
_DOUBLES = T.ArrayType(T.DoubleType())


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (values.value_lengths().to_numpy(zero_copy_only=False) * len(values) != len(flat)).any():
        raise ValueError("vectors of different length in one group")
    return flat.reshape(len(values), -1)


def _keyed(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """(key, its slices) of batches sorted by their first n_keys columns."""

    def cuts():
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(n_keys)))) or [()] * b.num_rows
            start = 0
            for i in range(1, b.num_rows + 1):
                if i == b.num_rows or keys[i] != keys[start]:
                    yield keys[start], b.slice(start, i - start)
                    start = i

    for key, group in itertools.groupby(cuts(), key=lambda x: x[0]):
        yield key, (b for _, b in group)


def _tiles(x: np.ndarray, y: np.ndarray, tile: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(kind, i, j, product): X'Y, and the upper halves of X'X and Y'Y, where kind 1 and 2 count twice off the diagonal."""
    for kind, a, b in ((0, x, y), (1, x, x), (2, y, y)):
        for i in range(0, a.shape[1], tile):
            for j in range(0 if kind == 0 else i, b.shape[1], tile):
                yield kind, i // tile, j // tile, a[:, i : i + tile].T @ b[:, j : j + tile]


def _squares(kind: int, i: int, j: int, product: np.ndarray) -> float:
    return float((product * product).sum()) * (2 if kind and i != j else 1)


def _block_products(n_keys: int, tile: int, schema: pa.Schema):
    """mapInArrow over (keys, block, blocks, x, y) with the group's means as the first row of each block."""

    def run(batches):
        for key, parts in _keyed(batches, n_keys + 2):
            xs, ys = [], []
            for b in parts:
                xs.append(_matrix(b.column("x")))
                ys.append(_matrix(b.column("y")))
            if len({v.shape[1] for v in xs}) > 1 or len({v.shape[1] for v in ys}) > 1:
                raise ValueError("vectors of different length in one group")
            x, y = np.concatenate(xs), np.concatenate(ys)
            del xs, ys
            x, y = x[1:] - x[0], y[1:] - y[0]
            by, blocks = key[:n_keys], key[-1]
            k, l = (x * x).sum(1), (y * y).sum(1)
            sums = dict(zip(SUMS, (len(x), k.sum(), l.sum(), (k * l).sum(), (k * k).sum(), (l * l).sum(), 0.0, 0.0, 0.0)))
            for kind, i, j, product in _tiles(x, y, tile):
                if blocks == 1:
                    sums[("fxy", "fxx", "fyy")[kind]] += _squares(kind, i, j, product)
                else:
                    yield _row(schema, by, kind, i, j, product.ravel())
            yield _row(schema, by, -1, 0, 0, np.array([sums[c] for c in SUMS]))

    return run


def _row(schema: pa.Schema, by: tuple, *values) -> pa.RecordBatch:
    arrays = [pa.array([v], f.type) for v, f in zip((*by, *values[:-1]), schema)]
    return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array([0, len(values[-1])], pa.int32()), pa.array(values[-1]))], schema=schema)


def _added_tiles(n_keys: int, schema: pa.Schema):
    """mapInArrow over rows sorted by (keys, kind, i, j): SUMS of each place of a tile."""

    def run(batches):
        for key, parts in _keyed(batches, n_keys + 3):
            total = None
            for b in parts:
                for v in b.column("v"):
                    part = v.values.to_numpy(zero_copy_only=False)
                    total = part.copy() if total is None else total + part
            by, (kind, i, j) = key[:n_keys], key[n_keys:]
            if kind >= 0:
                total = np.array([0.0] * 6 + [_squares(kind, i, j, total) if kind == k else 0.0 for k in range(3)])
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*by, *total), schema)], schema=schema)

    return run


def tiled_cka(
    pairs: DataFrame, by: list[str], row_key: str = "item_id", tile: int = TILE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """by, n, biased, debiased as from moments, for vectors of any width.

    pairs: by, row_key, x, y; a group's vectors have one width.  Rows are dealt to blocks by row_key,
    which should tell most of them apart.  Null keys are groups.  Fewer than four rows, or a
    self-term that is not positive, give a null debiased value.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def mean(c):
        return vector_to_array(Summarizer.mean(array_to_vector(F.col(c))))

    v = [F.col(c).cast(_DOUBLES).alias(c) for c in ("x", "y")]
    rows = pairs.select(*by, F.xxhash64(row_key).alias("h"), *v)
    wide = 8 * (F.max(F.size("x")) + F.max(F.size("y")))
    groups = rows.groupBy(*by).agg(
        mean("x").alias("x"), mean("y").alias("y"), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * wide / block_bytes)).cast("int").alias("blocks")
    )
    counts = groups.select(*[F.col(c).alias(f"_{c}") for c in by], "blocks")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    dealt = rows.join(counts, same).select(*by, F.pmod("h", F.col("blocks")).cast("int").alias("block"), "blocks", F.lit(1).alias("row"), "x", "y")
    means = groups.select(*by, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks", F.lit(0).alias("row"), "x", "y")
    keys = [*by, "block", "blocks"]
    placed = means.unionByName(dealt).repartition(*keys).sortWithinPartitions(*keys, "row").drop("row")
    kept = [T.StructField(c, pairs.schema[c].dataType) for c in by]
    places = T.StructType([*kept, *[T.StructField(c, T.IntegerType()) for c in ("kind", "i", "j")], T.StructField("v", _DOUBLES)])
    products = placed.mapInArrow(_block_products(len(by), tile, to_arrow_schema(places)), places)
    place = [*by, "kind", "i", "j"]
    sums = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in SUMS]])
    added = products.repartition(*place).sortWithinPartitions(*place).mapInArrow(_added_tiles(len(by), to_arrow_schema(sums)), sums)
    total = added.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])
    return total.select(*by, F.col("n").cast("bigint").alias("n"), *_values())


def _values() -> list[Column]:
    n = F.col("n")

    def hsic(f: str, cross: str, a: str, b: str) -> Column:
        return (F.col(f) - F.col(cross) - 2 * F.col(cross) / (n - 2) + F.col(a) * F.col(b) / ((n - 1) * (n - 2))) / (n * (n - 3))

    def within(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    hxx, hyy = hsic("fxx", "kk", "k", "k"), hsic("fyy", "ll", "l", "l")
    debiased = within(hsic("fxy", "kl", "k", "l") / F.sqrt(F.greatest(hxx * hyy, F.lit(1e-10))))
    squares = F.sqrt(F.col("fxx") * F.col("fyy"))
    return [
        F.when(squares > 0, within(F.col("fxy") / squares)).otherwise(0.0).alias("biased"),
        F.when(n >= 4, F.when((hxx > 0) & (hyy > 0), debiased)).alias("debiased"),
    ]
