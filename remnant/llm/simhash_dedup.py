"""SimHash near-duplicates over a hierarchical index in Gray order.

Fingerprints are sorted by Gray rank, in which neighbours differ in few bits and every run of
equal leading bits is one interval.  The index has these levels:

* Top nodes, spread over the cluster.  Three rotations bring each third of the 64 bits (22, 21,
  21) to the front; a top node is a run of equal front bits.  Two fingerprints with at most two
  differing bits agree on one third at least, so they meet under one top node of one rotation.
* Upper nodes inside a task: runs of FAN nodes of the level below, each with the bits that all
  its fingerprints share (mask and pattern).  Two nodes whose shared bits already differ in more
  than two places are pruned with everything below them.
* Leaves: single fingerprints, compared exactly.

Equal fingerprints are one entry whatever their number, and a task returns a spanning star of
what it linked, never its pairs.  A top node with more than CHUNK entries is dealt over several
tasks by (chunk, chunk) blocks; the blocks cover all its pairs.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remnant.llm.common import (
    components,
    deal_blocks,
    forest,
    group_starts,
    sorted_groups,
    text_udf,
    words,
)
from remnant.sources.storage import materialize, stored

SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENTS = (22, 21, 21)  # front bits by rotation
FAN = 8
CHUNK = 8192
FRONTIER = 65_536  # node pairs looked at together


def fingerprint_words(w: list[bytes]) -> int:
    """Fingerprint of lower-cased words: a bit is 1 if over half of the shingle hashes have it."""
    if not w:
        return 0
    k = min(SHINGLE, len(w))
    n = len(w) - k + 1
    joined = map(b" ".join, zip(*(w[i:] for i in range(k))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for s in range(0, n, 8192):
        part = h[s : s + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little").view(np.int64)
    return int(bits[0])


def _fingerprints(texts: list) -> dict:
    return {"fp": [fingerprint_words(words(t, lower=True)) for t in texts]}


def fingerprint(text: Column) -> Column:
    """64 bits as a long; null, empty and blank texts: 0.  Only A-Z are lower-cased."""
    return text_udf(_fingerprints, "fp bigint")(text.cast("string"))["fp"]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _tree(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the leaves up: (shared pattern, mask of shared bits) for runs of FAN nodes."""
    both, any_ = fp, fp
    levels = [(fp, np.full(len(fp), ~np.uint64(0)))]
    while len(both) > 1:
        at = np.arange(0, len(both), FAN)
        both, any_ = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(any_, at)
        mask = ~(both ^ any_)
        levels.append((both & mask, mask))
    return levels


def tree_links(fp: np.ndarray, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of a spanning forest of the links among `fp`, which is in Gray order.

    split: only links between positions below and from it.
    """
    levels = _tree(fp)
    found: tuple[list, list] = ([], [])
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, a, b = todo.pop()
        if len(a) > FRONTIER:
            todo.append((level, a[FRONTIER:], b[FRONTIER:]))
            a, b = a[:FRONTIER], b[:FRONTIER]
        pattern, mask = levels[level]
        differ = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b])
        near = differ <= DISTANCE
        a, b = a[near], b[near]
        if not len(a):
            continue
        if level == 0:
            real = a != b
            if split is not None:
                real &= (a < split) & (b >= split)
            x, y = forest(a[real], b[real])
            found[0].append(x)
            found[1].append(y)
            continue
        size = len(levels[level - 1][0])
        step = np.arange(FAN)
        x = (a[:, None, None] * FAN + step[None, :, None]).repeat(FAN, 2).ravel()
        y = (b[:, None, None] * FAN + step[None, None, :]).repeat(FAN, 1).ravel()
        keep = (x < size) & (y < size) & (x <= y)
        todo.append((level - 1, x[keep], y[keep]))
    if not found[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(found[0]), np.concatenate(found[1]))


def _link_groups(batches):
    """Links of each (rotation, node, block) group as (a, b) stars of ids."""
    for t in sorted_groups(batches, ["r", "node", "lo", "hi"]):
        key = [t.column(c).to_numpy() for c in ("r", "node", "lo", "hi")]
        chunk, ids = t.column("chunk").to_numpy(), t.column("id").to_numpy()
        fp = t.column("fp").to_numpy().view(np.uint64)
        starts = group_starts(key)
        size = np.diff(starts)
        out_a, out_b = [], []
        # Groups that fit one leaf node: neighbours at each distance, for all groups at once.
        of = np.repeat(np.arange(len(size)), size)
        small = size[of] <= FAN
        for d in range(1, FAN):
            i = np.flatnonzero(small[:-d] & (of[:-d] == of[d:])) if d < len(of) else of[:0]
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= DISTANCE]
            out_a.append(ids[i])
            out_b.append(ids[i + d])
        for g in np.flatnonzero(size > FAN):
            s = slice(starts[g], starts[g + 1])
            f, own, c = fp[s], ids[s], chunk[s]
            rot = _rotate(f, int(key[0][s.start]))
            order = np.argsort(gray_rank(rot), kind="stable")
            if key[2][s.start] != key[3][s.start]:  # a block of two chunks
                order = np.concatenate([order[c[order] == key[2][s.start]], order[c[order] != key[2][s.start]]])
                split = int((c == key[2][s.start]).sum())
                i, j = tree_links(f[order], split)
            else:
                i, j = tree_links(f[order])
            out_a.append(own[order[i]])
            out_b.append(own[order[j]])
        if out_a:
            a, b = forest(np.concatenate(out_a), np.concatenate(out_b))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _rotate(fp: np.ndarray, r: int) -> np.ndarray:
    """Bring the front bits of rotation r to the front."""
    s = np.uint64(sum(SEGMENTS[:r]))
    return fp if r == 0 else (fp << s) | (fp >> (np.uint64(64) - s))


def _node(fp: Column, r: int) -> Column:
    """Front bits of rotation r, unsigned."""
    before, width = sum(SEGMENTS[:r]), SEGMENTS[r]
    return F.shiftrightunsigned(F.shiftleft(fp, before), 64 - width)


def links(classes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) joining the ids of fingerprints at two or fewer differing bits.

    classes: id, fp, one row per distinct fingerprint.  The edges connect exactly the
    components of the full link graph.
    """
    rows = classes.select(
        "id", "fp",
        F.posexplode(F.array(*[_node(F.col("fp"), r) for r in range(3)])).alias("r", "node"),
    )
    dealt = deal_blocks(rows, ["r", "node"], F.col("fp"), chunk)
    key = ["r", "node", "lo", "hi"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_link_groups, "a bigint, b bigint")


def classes_of(fingerprints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(fp, class) per distinct fp; classes are named by their least fingerprint, never by an id."""
    merged = components(links(fingerprints.select(F.col("fp").alias("id"), "fp"), chunk))
    return fingerprints.join(merged, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("class"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs; component_id is the smallest id reachable.

    Rows with equal ids and texts stay rows, and rows that share an id only are no link.  Texts
    without words have fingerprint zero and link like any other.  A null id gets a fingerprint,
    and a null component unless its fingerprint also occurs with an id.  Other columns of docs
    are ignored.
    """
    rows = materialize(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")))
    named = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("id")).filter("id is not null"))
    found = materialize(named.join(classes_of(named, chunk), "fp"))
    least = found.groupBy("class").agg(F.min("id").alias("component_id"))
    final = found.join(least, "class").select("fp", "component_id")
    return rows.join(final, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest id, then the least text.

    Rows without an id are told apart by their texts like others, and one of each component stays
    beside the one with an id.  Every row has a number of its own, so equal ids join nothing.
    """
    rows, _ = stored(
        docs.select(
            F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row"), fingerprint(F.col(text_col)).alias("fp"),
            F.col(id_col).cast("bigint").alias("_id"),
        ),
        "rows",
    )
    found = classes_of(materialize(rows.select("fp").distinct()))
    keys = rows.select("_row", "fp", "_id").join(found, "fp").select("_row", "class", "_id", F.col("_id").isNull().alias("_null"))
    keys, _ = stored(keys, "keys")
    first = keys.groupBy("class", "_null").agg(F.min("_id").alias("_id"))
    same = (keys["class"] == first["class"]) & keys["_id"].eqNullSafe(first["_id"])
    tied, _ = stored(keys.join(first, same, "left_semi"), "tied")
    # Texts are only compared where several rows have the least id.
    count = tied.groupBy("class", "_null").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("_row"))
    several = tied.join(count.filter("n > 1").select("class", "_null"), ["class", "_null"], "left_semi")
    texts = several.join(rows.select("_row", F.col("doc")[text_col].alias("_text")), "_row")
    least = texts.groupBy("class", "_null").agg(F.min(F.struct("_text", "_row"))["_row"].alias("_row"))
    keep = count.filter("n = 1").select("_row").unionByName(least.select("_row"))
    return rows.join(keep, "_row", "left_semi").select("doc.*")
