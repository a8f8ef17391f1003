"""Sampled SentencePiece segmentations: forward filtering, backward sampling; lossless decoding.

A text is a lattice: at each position, all pieces that match.  A piece of merge rank r has
weight (r + OFFSET) ** -THETA; a character that no piece covers is spelled by its byte pieces.
The forward pass sums the weights of all paths to each position, the backward pass draws one
path, each in proportion to its weight.

No piece reaches over the start of a blank run, so the lattice falls apart into independent
units (blanks with the word that follows, or a line end), and the forward pass runs once per
distinct unit of a slice of texts, for all units at once.  The backward pass draws for all
occurrences at once; its random numbers are a hash of the row's key, the occurrence and the
step, so that reruns and other partitionings agree.

Blanks are the sign U+2581, as the pieces write them; where the sign itself occurs in a text, it
is spelled by bytes.  Nothing is normalised or added, so decoding gives the text back.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
THETA = 0.4
OFFSET = 10.0
SEED = 3
SCALE = 2.0  # a factor per character, equal for all paths, that keeps sums near one
SLICE = 256
BLANK = "\u2581"
_KEPT_SIGN = "\ud800"  # stands for a sign of the text itself while units are cut
_UNIT = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = np.uint64(1_000_003)


class Pieces(NamedTuple):
    longest: int
    keys: list  # by length: sorted hashes of pieces and of beginnings of pieces
    ids: list  # by length: ids in that order, -1 for what is only a beginning
    weight: np.ndarray  # by id
    byte: np.ndarray  # id of each byte piece
    text: list  # bytes of each id


@functools.lru_cache(maxsize=2)
def pieces(path: str = VOCABULARY, theta: float = THETA) -> Pieces:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    byte, text, by_length = np.zeros(256, np.int64), [b""] * n, {}
    plain = []
    for i, name in enumerate(names):
        if model.is_byte(i):
            byte[int(name[3:5], 16)] = i
            text[i] = bytes([int(name[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            plain.append(i)
            text[i] = name.replace(BLANK, " ").encode()
            by_length.setdefault(len(name), {}).setdefault(name, i)
    rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
    weight = np.full(n, (len(plain) + OFFSET) ** -theta)
    for i, r in rank.items():
        weight[i] = (r + OFFSET) ** -theta
    longest = max(by_length)
    keys, ids = [None], [None]
    for length in range(1, longest + 1):
        own = {name[:length]: -1 for longer in range(length, longest + 1) for name in by_length.get(longer, {})}
        own |= by_length.get(length, {})
        h = _hash_strings(list(own), length)
        order = np.argsort(h)
        keys.append(h[order])
        ids.append(np.array(list(own.values()), np.int64)[order])
    return Pieces(longest, keys, ids, weight, byte, text)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hash_strings(names: list[str], length: int) -> np.ndarray:
    if not names:
        return np.zeros(0, np.uint64)
    c = _points("".join(names)).reshape(-1, length)
    h = np.zeros(len(names), np.uint64)
    for k in range(length):
        h = h * _BASE + c[:, k] + np.uint64(1)
    return h


def uniform(key: np.ndarray, a: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) from row key, occurrence and step."""
    with np.errstate(over="ignore"):
        x = key + a * _MIX[0] + np.uint64(step + 1) * _MIX[1]
    for shift, mix in ((30, _MIX[1]), (27, _MIX[2])):
        x = (x ^ (x >> np.uint64(shift))) * mix
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


class Lattice(NamedTuple):
    """Of the distinct units of a slice.  Units are ranked from long to short, so that the ends of
    all prefixes of d characters are neighbours: the row of (unit, d) is offset[d] + rank."""

    rank: np.ndarray
    length: np.ndarray
    offset: np.ndarray
    share: np.ndarray  # by row and length of the last piece: cumulative chance
    edge: np.ndarray  # by row and length: piece; -2 - c: bytes of character c


def lattice(units: list[str], p: Pieces) -> Lattice:
    length = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-length, kind="stable")
    rank = np.empty(len(units), np.int64)
    rank[order] = np.arange(len(units))
    longest = int(length.max(initial=0))
    many = len(units) - np.searchsorted(length[order[::-1]], np.arange(1, longest + 1))  # units of d characters or more
    offset = np.concatenate([[0, 0], np.cumsum(many)])[: longest + 1]
    rows, most = int(many.sum()), min(p.longest, max(1, longest))
    c = _points("".join(units))
    start = np.cumsum(length) - length
    unit = np.repeat(np.arange(len(units)), length)
    depth = np.arange(len(c)) - start[unit]
    place, room = rank[unit], length[unit] - depth
    edge = np.full((rows, most), -1, np.int32)
    weight = np.zeros((rows, most), np.float32)
    at, h = np.arange(len(c)), np.zeros(len(c), np.uint64)
    covered = np.zeros(len(c), bool)
    for k in range(1, most + 1):
        fits = room[at] >= k
        at, h = at[fits], h[fits]
        if not len(at):
            break
        h = h * _BASE + c[at + k - 1] + np.uint64(1)
        spot = np.minimum(np.searchsorted(p.keys[k], h), len(p.keys[k]) - 1)
        begins = p.keys[k][spot] == h
        at, h, ids = at[begins], h[begins], p.ids[k][spot[begins]]
        real = ids >= 0
        row = offset[depth[at[real]] + k] + place[at[real]]
        edge[row, k - 1] = ids[real]
        weight[row, k - 1] = p.weight[ids[real]] * SCALE**k
        if k == 1:
            covered[at[real]] = True
    bare = np.flatnonzero(~covered)
    row = offset[depth[bare] + 1] + place[bare]
    edge[row, 0] = -2 - c[bare].astype(np.int64)
    weight[row, 0] = SCALE * p.weight[p.byte[0]] ** (1 + (c[bare] > 0x7F) + (c[bare] > 0x7FF) + (c[bare] > 0xFFFF))
    # Forward pass: sums of path weights, all units together, one depth after the other.
    share = np.full((rows, most), 2.0, np.float32)
    alpha = [np.ones(len(units))]
    for d in range(1, longest + 1):
        own = slice(offset[d], offset[d] + many[d - 1])
        total = np.zeros(many[d - 1])
        sums = []
        for k in range(1, min(d, most) + 1):
            total = total + alpha[-k][: len(total)] * weight[own, k - 1]
            sums.append(total)
        for k, t in enumerate(sums[:-1]):
            share[own, k] = np.where(t < total, t / total, 2.0)
        alpha.append(total)
        if total.min() < 1e-200 or total.max() > 1e200:  # ratios count alone
            alpha = [x[: len(total)] / total for x in alpha[-most:]]
        elif len(alpha) > most:
            alpha.pop(0)
    return Lattice(rank, length, offset, share, edge)


def sample(texts: list, keys: np.ndarray, p: Pieces) -> list[np.ndarray]:
    """Sampled piece ids of each text; null and empty texts have none."""
    known: dict[str, int] = {}
    found: list[list[int]] = []
    for t in texts:
        body = (t or "").replace(BLANK, _KEPT_SIGN).replace(" ", BLANK)
        found.append([known.setdefault(u, len(known)) for u in _UNIT.findall(body)])
    many = np.array([len(f) for f in found], np.int64)
    total = int(many.sum())
    if not total:
        return [np.zeros(0, np.int32) for _ in texts]
    grid = lattice(list(known), p)
    unit = np.fromiter((u for f in found for u in f), np.int64, total)
    key = np.repeat(keys, many)
    number = (np.arange(total) - np.repeat(np.cumsum(many) - many, many)).astype(np.uint64)
    place, depth = grid.rank[unit], grid.length[unit]
    live = np.arange(total)
    steps = np.zeros(total, np.int64)
    log: list[tuple[np.ndarray, np.ndarray]] = []
    step = 0
    while len(live):
        u = uniform(key[live], number[live], step).astype(np.float32)
        row = grid.offset[depth[live]] + place[live]
        length = (grid.share[row] <= u[:, None]).sum(axis=1)
        log.append((live, grid.edge[row, length]))
        depth[live] -= length + 1
        steps[live] += 1
        live = live[depth[live] > 0]
        step += 1
    ends = np.cumsum(steps)
    edges = np.zeros(int(ends[-1]), np.int64)
    for k, (who, e) in enumerate(log):
        edges[ends[who] - 1 - k] = e
    edges = _spell(edges, np.repeat(np.arange(total), steps), p)
    per_text = np.repeat(np.arange(len(texts)), many)
    size = np.bincount(per_text[edges[1]], minlength=len(texts))
    return np.split(edges[0].astype(np.int32), np.cumsum(size)[:-1])


def _spell(edge: np.ndarray, owner: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters without a piece by their byte pieces."""
    odd = np.flatnonzero(edge < -1)
    if not len(odd):
        return edge, owner
    code, of = np.unique(-2 - edge[odd], return_inverse=True)
    spelled = [p.byte[list(_utf8(int(c)))] for c in code]
    n = np.ones(len(edge), np.int64)
    n[odd] = np.array([len(s) for s in spelled])[of]
    out = np.repeat(edge, n)
    at = np.cumsum(n) - n
    width = n[odd]
    for k in range(int(width.max())):
        here = odd[width > k]
        table = np.array([s[k] if len(s) > k else 0 for s in spelled])
        out[at[here] + k] = table[of[width > k]]
    return out, np.repeat(owner, n)


def _utf8(code: int) -> bytes:
    return BLANK.encode() if chr(code) == _KEPT_SIGN else chr(code).encode("utf-8", "replace")


def decode_ids(ids: list, table: list) -> str:
    """The text of piece ids; bytes that are no UTF-8 become the replacement sign."""
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def _encoder(vocabulary: str, theta: float, check: bool):
    """Batches of (texts, keys) to pieces, or to pieces and whether they decode to the text."""

    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        p = pieces(vocabulary, theta)
        parts = []
        k = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for s in range(0, len(texts), SLICE):
            own = texts.slice(s, SLICE).to_pylist()
            got = sample(own, k[s : s + SLICE], p)
            ends = np.cumsum([0, *(len(g) for g in got)])
            whole = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.concatenate(got).astype(np.int32)), mask=pa.array([t is None for t in own])
            )
            if check:
                same = [t is None or decode_ids(g.tolist(), p.text) == t for t, g in zip(own, got)]
                whole = pa.StructArray.from_arrays([whole, pa.array(same)], ["pieces", "lossless"])
            parts.append(whole)
        kind = pa.list_(pa.int32())
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("pieces", kind), ("lossless", pa.bool_())]) if check else kind)

    return run


def _key(key: Column) -> Column:
    return F.coalesce(F.xxhash64(F.lit(SEED), key), F.lit(0))


def encode(text: Column, key: Column, vocabulary: str = VOCABULARY, theta: float = THETA) -> Column:
    """array<int> of sampled pieces.  Null texts give null, empty ones an empty array.

    Texts with equal keys and equal content get equal pieces; a null key counts as a key.
    """

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return _encoder(vocabulary, theta, False)(texts, keys)

    return run(text.cast("string"), _key(key))


def encode_checked(text: Column, key: Column, vocabulary: str = VOCABULARY, theta: float = THETA) -> Column:
    """Struct of the pieces as `encode` draws them, and whether decoding them gives the text."""

    @arrow_udf(T._parse_datatype_string("pieces array<int>, lossless boolean"))
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return _encoder(vocabulary, theta, True)(texts, keys)

    return run(text.cast("string"), _key(key))


def decode(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text of an array of pieces; null arrays give null.  Null elements are skipped."""

    @arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        table = pieces(vocabulary).text
        parts = []
        for s in range(0, len(rows), SLICE):
            texts = [None if r is None else decode_ids([i for i in r if i is not None], table) for r in rows.slice(s, SLICE).to_pylist()]
            parts.append(pa.array(texts, pa.string()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run(ids)
