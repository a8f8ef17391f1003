"""Operators whose definition involves all pairs of items: RBF CKA, distance matrices, RSA.

Items are cut into blocks of bounded size and blocks are joined by their numbers, so work
spreads over (group, block, block) tasks however large a group is.  RBF CKA aggregates
inside the block pair and never emits item pairs.  A distance matrix is the set of pairs
by definition; take it over entity means unless the item matrix itself is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remnant.functions import kernels as K
from remnant.operators.similarity import PROFILE, _by_key, _fields, _map, mean_vector
from remnant.operators.stats import _p_value, correlate
from remnant.sources.storage import materialize, stored

BLOCK = 3 << 13  # items; kernels hold the distances of a small tile of a block pair
NUMBERS = 1 << 19  # of a block's matrix: wide vectors come in smaller blocks
PAIRS = 512  # items of a block whose pairs are given out as rows
TOGETHER = 8  # groups with the same base that share a task
SHIFTS = 8  # tiles of sampled pairs that an item is in, for the bracket of a median


def item_blocks(pairs: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """Items of a group in hashed blocks of about `block` rows: by, _nb, _b, items."""
    most = F.least(F.lit(float(block)), F.ceil(F.lit(NUMBERS) / F.greatest(F.max(F.size("x")), F.lit(1))))
    counts = pairs.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / most).alias("_nb"))
    rows = _by_key(pairs, counts, by).withColumn("_b", F.pmod(F.xxhash64("item_id"), F.col("_nb")))
    # Sorted, so that every evaluation of a block does the same arithmetic.
    return rows.groupBy(*by, "_nb", "_b").agg(
        F.array_sort(F.collect_list(F.struct("item_id", "x", "y"))).alias("items")
    )


def _tasks(df: DataFrame) -> int:
    """For rows of many bytes, of which a task should hold few at once."""
    return 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def block_pairs(blocks: DataFrame, by: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, bi, bj, a, b, carry) with bi <= bj: two blocks of items of one group.

    A block paired with itself is sent once, and b is NULL.  `carry` are columns that are equal in all
    blocks of a group.  The work per row is large and its bytes are few, so the number of partitions is stated
    instead of left to size-based merging.
    """
    parts = _tasks(blocks)
    # One key that is never NULL, as pooled vectors have no layer.
    keys, group = ["_g", "bi", "bj"], F.to_json(F.struct(*by)).alias("_g")
    left = blocks.select(
        *by, group, F.col("_b").alias("bi"), F.explode(F.sequence("_b", F.col("_nb") - 1)).alias("bj"),
        F.col("items").alias("a"), *carry,
    )
    right = blocks.select(
        group, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_b"))).alias("bi"),
        F.col("_b").alias("bj"), F.col("_b").alias("_own"), F.col("items").alias("_items"),
    ).select("_g", "bi", "bj", F.when(F.col("bi") != F.col("_own"), F.col("_items")).alias("b"))
    joined = left.repartition(parts, *keys).join(right.repartition(parts, *keys), keys)
    return joined.select(*by, "bi", "bj", "a", "b", *carry)


def _packed(pairs: DataFrame, by: list[str], block: int, metric: str, shifts: int) -> DataFrame:
    """Blocks of a group as matrices, with facts of both sides; stored, as several passes read them."""
    blocks = item_blocks(pairs, by, block)
    item = blocks.schema["items"].dataType.elementType["item_id"].dataType
    facts = (T.IntegerType(), T.BooleanType(), T.LongType(), T.LongType(), T.BinaryType(), T.LongType())
    schema = T.StructType(
        _fields(blocks, [*by, "_nb", "_b"])
        + [T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(item)), T.StructField("same", T.StringType())]
        + [
            T.StructField(name, kind)
            for s in "xy"
            for name, kind in ((s, T.BinaryType()), *zip((f"{f}_{s}" for f in K.SIDE), facts))
        ]
    )
    return materialize(_map(blocks, schema, K.pack_blocks, by, metric=metric, shifts=shifts))


_SIDES = ["_p", "_q"]  # hashes of the vectors of a side
_BRACKET = ("_lo", "_hi", "_cells")  # distances of a side between which they are looked at closely, and in how many bins


def _brackets(packed: DataFrame, by: list[str], share: float | None = None, cells: int = 1) -> DataFrame:
    """Of both sides of a group: hashes of its vectors and a bracket of distances (see `side_facts`)."""
    facts = F.struct("n", *[f"{f}_{s}" for s in "xy" for f in K.SIDE])
    groups = packed.groupBy(*by).agg(F.collect_list(facts).alias("blocks"))
    schema = T.StructType(
        _fields(packed, by)
        + [T.StructField("side", T.StringType()), T.StructField("finite", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in _SIDES]
        + [T.StructField(c, T.DoubleType()) for c in ("_lo", "_hi")]
        + [T.StructField("_cells", T.IntegerType())]
    )
    return stored(_map(groups, schema, K.side_facts, by, share=share, cells=cells), "sides")[0]


def _side_pairs(packed: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """Block pairs of one side each.  Sides that hold the same vectors, as those of a base run do, come once."""
    first = brackets.filter("finite").groupBy(*_SIDES).agg(F.min(F.struct(*by, "side", *_BRACKET)).alias("r"))
    own = _by_key(packed, first.select(*_SIDES, "r.*"), by)
    matrix = F.when(F.col("side") == "x", F.col("x")).otherwise(F.col("y"))
    blocks = own.select(*_SIDES, "_nb", "_b", F.struct("n", matrix.alias("x")).alias("items"), *_BRACKET)
    return block_pairs(blocks, _SIDES, _BRACKET)


def _base_pairs(packed: DataFrame, own: DataFrame, by: list[str], x: list[str], y: list[str], *ids: str) -> DataFrame:
    """Block pairs of groups whose x are the same, item by item, as those of the runs of one base: up to TOGETHER in a row.

    `own` has the columns `x` and `y` of each group, which also agree in `x`.  Those of `y` come as
    `facts`, beside the key of the group.
    """
    blocks = F.array_sort(F.collect_list(F.struct("_b", "same")))
    base = packed.groupBy(*by).agg(F.md5(F.to_json(blocks)).alias("_base"))
    # Equal in what decides on x: a bracket or a width, but not a long table.
    alike = ["_base", *[c for c in x if c != "ranks_x"]]
    place = F.row_number().over(Window.partitionBy(*alike).orderBy(*by)) - 1
    base = _by_key(base, own, by).withColumn("_k", place).withColumn("_part", F.floor(F.col("_k") / TOGETHER))
    keys = [*alike, "_part"]
    nested = _by_key(packed.select(*by, "_nb", "_b", "n", "ids", "x", "y"), base, by).groupBy(*keys, "_nb", "_b").agg(
        *[F.first(c).alias(c) for c in ("n", "x", *[c for c in x if c == "ranks_x"])],
        F.array_sort(F.collect_list(F.struct("_k", "y", *ids))).alias("groups"),
        F.array_sort(F.collect_list(F.struct("_k", F.struct(*by).alias("key"), *y))).alias("facts"),
    )
    items = nested.withColumn("items", F.struct("n", "x", "groups")).select(*keys, *[c for c in x if c not in keys], "_nb", "_b", "items", "facts")
    return block_pairs(items, keys, ("facts", *[c for c in x if c not in keys]))


def _by_side(found: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """One row per group from one per side: by, name_x and name_y."""
    return found.groupBy(*by).agg(
        *[F.first(F.when(F.col("side") == s, F.col(c)), True).alias(f"{c}_{s}") for c in names for s in "xy"]
    )


def _matrices(packed: DataFrame, *more: str) -> DataFrame:
    return packed.withColumn("items", F.struct("n", *more, "x", "y"))


def sigma_of_blocks(packed: DataFrame, by: list[str]) -> DataFrame:
    """As `median_sigma`, in one pass over all pairs of each distinct side: by, sigma_x, sigma_y.

    A sample of pairs gives a bracket; the pass counts the distances below it and gives out those in
    it, of which one is the median.  Groups where it is not, or whose numbers are not all finite, go
    through `median_sigma`.
    """
    brackets = _brackets(packed, by)
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in (*_SIDES, "n", "below")]
        + [T.StructField("over", T.BooleanType()), T.StructField("near", T.BinaryType()), T.StructField("counts", T.BinaryType())]
    )
    near = _map(_side_pairs(packed, brackets, by), schema, K.near_median, _SIDES)
    schema = T.StructType([*schema.fields[:2], T.StructField("median", T.DoubleType())])
    near = near.repartition(_tasks(near), *_SIDES).sortWithinPartitions(*_SIDES)
    medians = brackets.join(_map(near, schema, K.pick_median, _SIDES), _SIDES, "left")
    medians = medians.withColumn("sigma", F.sqrt("median") + F.lit(1e-8))
    sigma = stored(_by_side(medians, by, ["sigma"]), "sigma")[0]
    known = F.col("sigma_x").isNotNull() & F.col("sigma_y").isNotNull()
    odd = sigma.filter(~known)
    if odd.isEmpty():
        return sigma
    rest = _by_key(_matrices(packed), odd.select(*by), by)
    return sigma.filter(known).unionByName(median_sigma(block_pairs(rest, by), by))


_COARSE, _FINE = 40, 14  # bits dropped from the 64-bit pattern of a squared distance


def _selected(hist: DataFrame, by: list[str], want: DataFrame | None) -> DataFrame:
    """Bin that holds the lower median per (group, side), and the rank left inside it."""
    keys = [*by, "side"]
    bins = hist.groupBy(*keys, "bin").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*keys).orderBy("bin")
    cum = bins.withColumn("cum", F.sum("c").over(w)).withColumn("prev", F.col("cum") - F.col("c"))
    if want is None:
        total = F.sum("c").over(Window.partitionBy(*keys))
        cum = cum.withColumn("rank", F.floor((total - 1) / 2) + 1)
    else:
        cum = _by_key(cum, want.select(*keys, "rank"), keys)
    hit = F.col("cum") >= F.col("rank")
    return cum.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(hit, F.col("bin"))), F.max("bin")).alias("bin"),
        # The first hit has the largest remaining rank.
        F.max(F.when(hit, F.col("rank") - F.col("prev"))).alias("rank"),
    )


def _wide(sel: DataFrame, by: list[str], expr) -> DataFrame:
    return sel.groupBy(*by).agg(
        *[F.max(F.when(F.col("side") == s, expr)).alias(n) for s, n in (("x", "px"), ("y", "py"))]
    )


def median_sigma(blocks: DataFrame, by: list[str]) -> DataFrame:
    """sqrt(lower median of all squared distances, zeros included) + 1e-8 for both sides.

    Two counting passes over leading bits; the value is right to 38 leading bits of the
    mantissa and needs no sorted list of n^2 distances.
    """
    schema = T.StructType(
        _fields(blocks, by)
        + [
            T.StructField("side", T.StringType()),
            T.StructField("bin", T.LongType()),
            T.StructField("c", T.LongType()),
        ]
    )
    coarse = _selected(_map(blocks, schema, K.distance_histogram, by, shift=_COARSE), by, None)
    coarse = materialize(coarse)  # two rows per group, used twice below
    marked = _by_key(blocks, _wide(coarse, by, F.col("bin")), by)
    fine = _selected(
        _map(marked, schema, K.distance_histogram, by, shift=_FINE, prefix_shift=_COARSE), by, coarse
    )
    # The bin number shifted back is the bit pattern of the distance.
    bits = F.shiftleft("bin", _FINE)
    value = _bits_to_double(bits)
    sigma = _wide(fine.withColumn("s", F.sqrt(value) + F.lit(1e-8)), by, F.col("s"))
    return sigma.select(*by, F.col("px").alias("sigma_x"), F.col("py").alias("sigma_y"))


def _bits_to_double(bits):
    """Double with the given non-negative IEEE bit pattern, in plain arithmetic."""
    exponent = F.shiftright(bits, 52)
    mantissa = bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / F.lit(float(1 << 52))
    normal = (F.lit(1.0) + mantissa) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
    return F.when(exponent > 0, normal).otherwise(mantissa * F.lit(2.0**-1022))


def rbf_cka(pairs: DataFrame, by: list[str] | None = None, block: int = BLOCK, sigma: DataFrame | None = None) -> DataFrame:
    """CKA with Gaussian kernels and double centring: by, n, cka."""
    by = by or PROFILE
    packed = _packed(pairs, by, block, "squared", SHIFTS)
    sigma = sigma_of_blocks(packed, by) if sigma is None else sigma
    blocks = _base_pairs(packed, sigma, by, ["sigma_x"], ["sigma_y"], "ids")
    schema = T.StructType(
        _fields(packed, by)
        + [T.StructField("item_id", packed.schema["ids"].dataType.elementType)]
        + [T.StructField(c, T.DoubleType()) for c in ("rx", "ry", "xy", "xx", "yy")]
    )
    parts = _map(blocks, schema, K.rbf_sums, by)
    per_item = parts.groupBy(*by, "item_id").agg(
        *[F.sum(c).alias(c) for c in ("rx", "ry", "xy", "xx", "yy")]
    )
    is_item = F.col("item_id").isNotNull()
    t = per_item.groupBy(*by).agg(
        F.count_if(is_item).alias("n"),
        F.sum("rx").alias("tx"), F.sum("ry").alias("ty"),
        F.sum(F.col("rx") * F.col("ry")).alias("rxy"),
        F.sum(F.col("rx") * F.col("rx")).alias("rxx"),
        F.sum(F.col("ry") * F.col("ry")).alias("ryy"),
        F.sum("xy").alias("xy"), F.sum("xx").alias("xx"), F.sum("yy").alias("yy"),
    )

    def centred(s: str, r: str, a: str, b: str):
        n = F.col("n").cast("double")
        return F.col(s) - 2 * F.col(r) / n + F.col(a) * F.col(b) / (n * n)

    hxy = centred("xy", "rxy", "tx", "ty")
    denom = F.sqrt(F.greatest(F.lit(0.0), centred("xx", "rxx", "tx", "tx") * centred("yy", "ryy", "ty", "ty")))
    value = F.when(denom > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), hxy / denom))).otherwise(F.lit(0.0))
    return t.select(*by, "n", value.alias("cka"))


def entity_means(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per entity: means of both representations, keyed as items."""
    by = by or PROFILE
    return pairs.groupBy(*by, F.col("entity").alias("item_id")).agg(
        mean_vector("x").alias("x"), mean_vector("y").alias("y")
    )


def rdm(pairs: DataFrame, metric: str = "cosine", by: list[str] | None = None, block: int = PAIRS) -> DataFrame:
    """Upper triangle of both distance matrices: by, i, j, d_x, d_y."""
    if metric not in ("cosine", "euclidean", "correlation"):
        raise ValueError(f"unknown metric {metric}")
    by = by or PROFILE
    blocks = block_pairs(item_blocks(pairs, by, block), by)
    item = blocks.schema["a"].dataType.elementType["item_id"].dataType
    schema = T.StructType(
        _fields(blocks, by)
        + [T.StructField("i", item), T.StructField("j", item)]
        + [T.StructField("d_x", T.DoubleType()), T.StructField("d_y", T.DoubleType())]
    )
    return _map(blocks, schema, K.pair_distances, by, metric=metric)


def rsa(
    pairs: DataFrame, metric: str = "cosine", by: list[str] | None = None, block: int = PAIRS,
    p_values: bool = True,
) -> DataFrame:
    """Spearman correlation of both distance matrices: by, n (pairs), rho, p."""
    by = by or PROFILE
    # Distances that should be equal differ in the last digits; ranks need real ties.
    d = rdm(pairs, metric, by, block).withColumns(
        {"d_x": F.round("d_x", 12), "d_y": F.round("d_y", 12)}
    )
    # Stored once: ranking reads the distances several times.
    out = correlate(d, "d_x", "d_y", by, p_values)
    cols = [*by, "n", F.col("spearman_r").alias("rho")]
    return out.select(*cols, F.col("spearman_p").alias("p")) if p_values else out.select(*cols)


CELLS = 1 << 17  # of ranks that a block pair carries per side: 2 MB
SHARED = 64  # block pairs of a group that one copy of its ranks serves
_RANKS, _CLOSE = 34, 16  # bits dropped from a distance's 64 in all bins, and in heavy ones


def rsa_of_items(
    pairs: DataFrame, metric: str = "cosine", by: list[str] | None = None, block: int = BLOCK, cells: int = CELLS,
) -> DataFrame:
    """Spearman correlation of both distance matrices of many items: by, n (pairs), rho, p.

    As `rsa`, without a list of pairs.  Groups of one block with up to 16 * `cells` pairs are ranked
    whole.  Of others a first pass counts distances in bins of equal width, cells / 2 or more of them,
    and a second looks ranks up and adds up their products (`_by_bins`).  Distances of one bin share a
    rank, which takes at most 64 / cells^2 of the variance of the ranks and moves rho by about
    2 / (bins * sqrt(pairs)), some 1e-8 at most for the default.  Where sharing would take more, as with many
    equal or very unevenly spread distances, or where numbers are not finite, distances are counted by
    their leading bits (`_by_bits`): two share a rank if they agree in 36 binary digits or if all
    between them are at most 1 / `cells` of all pairs.
    Pairs without
    a finite distance on both sides are left out; fewer than three pairs, or distances all
    alike, give a NULL rho.
    """
    if metric not in ("cosine", "euclidean", "correlation"):
        raise ValueError(f"unknown metric {metric}")
    by = by or PROFILE
    packed = _packed(pairs, by, block, metric, 1)
    whole = (F.col("_nb") == 1) & (F.col("n") * (F.col("n") - 1) <= F.lit(32 * cells))
    schema = T.StructType([*_fields(packed, by), T.StructField("n", T.LongType()), T.StructField("rho", T.DoubleType())])
    out = _map(packed.filter(whole), schema, K.whole_rho, by, metric=metric)
    large = packed.filter(~whole)
    if not large.isEmpty():
        ranked, odd = _by_bins(large, by, metric, cells)
        out = out.unionByName(ranked)
        if not odd.isEmpty():
            out = out.unionByName(_by_bits(_by_key(_matrices(large), odd, by), by, metric, cells))
    return out.withColumn("p", _p_value()("rho", F.col("n").cast("double")))


EDGE = 1e-4  # share of the sampled distances beyond the first and the last bin


def _rho():
    norm = F.sqrt(F.col("ss_x")) * F.sqrt(F.col("ss_y"))
    return F.when((F.col("n") >= 3) & (norm > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("xy") / norm)))


def _by_bins(packed: DataFrame, by: list[str], metric: str, cells: int) -> tuple[DataFrame, DataFrame]:
    """Groups whose distances spread over bins of equal width (by, n, rho), and the keys of the others.

    A sample gives the ends of the bins.  One pass counts the distances of each distinct side, and one
    looks their ranks up in both sides.
    """
    brackets = _brackets(packed, by, EDGE, max(cells // 2, 2))
    ends = [*_SIDES, "_lo", "_hi"]
    sides = _side_pairs(packed, brackets, by)
    schema = T.StructType([*_fields(sides, ends), T.StructField("counts", T.BinaryType())])
    counts = _map(sides, schema, K.bin_counts, ends, metric=metric)
    schema = T.StructType(
        [*_fields(sides, ends), T.StructField("n", T.LongType()), T.StructField("ok", T.BooleanType())]
        + [T.StructField("ss", T.DoubleType()), T.StructField("ranks", T.BinaryType())]
    )
    counts = counts.repartition(*_SIDES).sortWithinPartitions(*_SIDES)
    tables = _map(counts, schema, K.rank_tables, ends, most=64 / cells**2)
    tables = brackets.drop(*_BRACKET).join(tables, _SIDES, "left")
    tables = stored(_by_side(tables, by, ["n", "ok", "ss", "ranks", "_lo", "_hi"]), "ranks")[0]
    ok = F.coalesce(F.col("ok_x") & F.col("ok_y"), F.lit(False))
    sums = tables.filter(ok).select(*by, F.col("n_x").alias("n"), "ss_x", "ss_y")
    x, y = (["ranks_" + s, "_lo_" + s, "_hi_" + s] for s in "xy")
    blocks = _base_pairs(packed, tables.filter(ok).select(*by, *x, *y), by, x, y)
    schema = T.StructType([*_fields(packed, by), T.StructField("xy", T.DoubleType())])
    dots = _map(blocks, schema, K.rank_dots, by, metric=metric)
    xy = dots.groupBy(*by).agg(F.sum("xy").alias("xy"))
    return _by_key(sums, xy, by).select(*by, "n", _rho().alias("rho")), tables.filter(~ok).select(*by)


def _by_bits(stored_blocks: DataFrame, by: list[str], metric: str, cells: int) -> DataFrame:
    """Spearman correlation whatever the distances: by, n, rho.

    One pass over the block pairs counts distances by their leading bits, and a second looks closer at
    bins that hold more than 1 / `cells` of all pairs.  Counts turn into ranks, where neighbouring bins
    share a rank until about `cells` are left; a last pass looks ranks up and adds up their products.
    Ranks are sent once per SHARED block pairs, so that block pairs of one group stay spread over many tasks.
    """
    blocks = block_pairs(stored_blocks, by)
    schema = T.StructType(
        _fields(blocks, by)
        + [T.StructField("side", T.StringType()), T.StructField("bin", T.LongType()), T.StructField("c", T.LongType())]
    )
    keys = [*by, "side"]
    share = F.sum("c").over(Window.partitionBy(*keys)) / F.lit(float(cells))
    coarse = _map(blocks, schema, K.rank_histogram, by, metric=metric, shift=_RANKS).groupBy(*keys, "bin").agg(F.sum("c").alias("c"))
    coarse = materialize(coarse.withColumn("heavy", (F.col("c") > 1) & (F.col("c") > share)))
    heavy = coarse.groupBy(*by).agg(
        # Fewer than `cells` bins can hold more than that share.
        *[F.array_sort(F.collect_list(F.when(F.col("heavy") & (F.col("side") == s), F.col("bin")))).alias(f"heavy_{s}") for s in "xy"]
    )
    close = _map(_by_key(blocks, heavy, by), schema, K.rank_histogram, by, metric=metric, shift=_CLOSE, within=_RANKS)
    light = coarse.filter("not heavy").withColumn("bin", F.shiftleft(F.col("bin") + 1, _RANKS - _CLOSE) - 1)
    bins = light.select(*keys, "bin", "c").unionByName(close.groupBy(*keys, "bin").agg(F.sum("c").alias("c")))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("bin"))
    total = F.sum("c").over(Window.partitionBy(*keys))
    placed = bins.withColumns({"hi": upto, "total": total}).withColumn("lo", F.col("hi") - F.col("c"))
    # A bin goes by the rank of its middle, so that a heavy bin does not pull in those before it.
    middle = (F.col("lo") + F.col("hi")).cast("double") / 2 / F.col("total")
    shared = placed.withColumn("cell", F.floor(middle * F.lit(float(cells)))).groupBy(*keys, "cell").agg(
        F.max("bin").alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("total").alias("n"),
    )
    # Average rank, about the middle of all ranks.
    ranks = shared.withColumn("rank", (F.col("lo") + F.col("hi") - F.col("n")).cast("double") / 2)

    def side(s: str) -> list:
        of = F.col("side") == s
        table = F.array_sort(F.collect_list(F.when(of, F.struct("last", "rank"))))
        return [
            table["last"].alias(f"last_{s}"), table["rank"].alias(f"rank_{s}"),
            F.sum(F.when(of, (F.col("hi") - F.col("lo")) * F.col("rank") * F.col("rank"))).alias(f"ss_{s}"),
        ]

    table = materialize(ranks.groupBy(*by).agg(F.max("n").alias("n"), *side("x"), *side("y")))
    copies = F.floor(F.col("_nb") * F.col("_nb") / F.lit(SHARED)) + 1
    sizes = stored_blocks.groupBy(*by).agg(F.max(copies).alias("_copies"))
    salted = _by_key(blocks, sizes, by).withColumn("_salt", F.pmod(F.xxhash64("bi", "bj"), F.col("_copies")))
    spread = _by_key(table.drop("n", "ss_x", "ss_y"), sizes, by)
    spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1))).drop("_copies")
    looked = _by_key(salted, spread, [*by, "_salt"])
    sums = T.StructType([*_fields(blocks, by), T.StructField("xy", T.DoubleType())])
    xy = _map(looked, sums, K.rank_products, by, metric=metric, shift=_CLOSE, drop=_RANKS - _CLOSE).groupBy(*by).agg(F.sum("xy").alias("xy"))
    return _by_key(table.select(*by, "n", "ss_x", "ss_y"), xy, by).select(*by, "n", _rho().alias("rho"))
