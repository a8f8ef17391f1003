"""Cross-tokenizer alignment: links between the tokens of two vocabularies, counted by spilled runs.

Each text is encoded twice, by a byte-level vocabulary (A) and a piece vocabulary (B).  Byte
offsets where tokens of both end cut the text into groups; every A token of a group is linked to
every B token of it.  The count of an id pair is the number of documents that hold it linked.

1. Tasks encode documents and fill runs of (pair, document, times) records.  A full run is sorted
   and cut by a radix digit of the A id; each cut is one compressed row of a table in the shared
   folder, with pairs and documents in columns of their own.
2. Only the pair columns are shuffled, by digit.  The rows of a digit are dealt to as many salted
   groups as their number of records asks for, so that no id is hot.  A heap merges the runs of
   a group block by block and adds up documents per pair; sums of groups are added up by Spark.
3. The records meet the counts of their digit, which arrive in A-major order: the largest
   count of each A id is known as they are read, and every run streams its contributions back
   to its documents, which are summed by (run, document).

A space before a word, if no white space is before it, always starts a token of both, and neither
looks back past it.  Texts are therefore cut there, and a worker encodes and links a repeated unit
once; texts with runs of white space are one unit.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from remnant.sources.storage import stored

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

DIGIT_BITS = 6  # of the A id: 64 radix partitions
RUN_RECORDS = 4_000_000
RUN_DOCS = 1 << 16
GROUP_RECORDS = 16_000_000  # of a salted group
BLOCK = 4096  # pairs that the merge takes from a run at a time
SLICE_CHARS = 1_000_000
CACHE_CHARS = 6_000_000  # of units that a worker remembers
DIRECT = 16  # links of a group that are listed one by one

#: A blank that does not start a unit.
ODD_BLANK = re.compile(r"^ |\s | \Z")


def _byte_table() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, the others from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both vocabularies: ids and bytes of tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        with open(byte_path, encoding="utf-8") as f:
            names = json.load(f)["model"]["vocab"]
        table = _byte_table()
        self.a_bytes = [b""] * (max([*names.values(), self.a.get_vocab_size() - 1]) + 1)
        for name, k in names.items():
            self.a_bytes[k] = bytes(table[c] for c in name) if all(c in table for c in name) else name.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)
        ]
        self.b_bits = (len(pieces) - 1).bit_length()
        self.a_bits = (len(self.a_bytes) - 1).bit_length()
        if self.a_bits + self.b_bits > 47:
            raise ValueError("vocabularies too large for 47 bits of a pair")
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)  # no piece goes past the start of a word
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space, which B adds itself."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        return a, self.b.encode([u[1:] for u in units], num_threads=1)

    def units(self, text: str) -> list[str]:
        """Parts of space + text that both tokenizers treat apart."""
        if not self.cuts or ODD_BLANK.search(text):
            return [f" {text}"]
        return [f" {w}" for w in text.split(" ")]


@functools.lru_cache(maxsize=2)
def tokenizers_of(byte_path: str = BYTE_VOCABULARY, piece_path: str = PIECE_VOCABULARY) -> Tokenizers:
    return Tokenizers(byte_path, piece_path)


def pair_key(a: np.ndarray, b: np.ndarray, t: Tokenizers) -> np.ndarray:
    """Pairs as numbers: radix digit of A, then the rest of A, then B."""
    high = t.a_bits - DIGIT_BITS
    return ((a & ((1 << DIGIT_BITS) - 1)) << (high + t.b_bits)) | ((a >> DIGIT_BITS) << t.b_bits) | b


def digit_shift(t: Tokenizers) -> int:
    return t.a_bits - DIGIT_BITS + t.b_bits


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of n."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(n[order], at)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each of the counts, in one array."""
    total = int(count.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(count) - count), count)


class Linked:
    """Groups and links of several units: CSR arrays by unit."""

    def __init__(self, units: list[str], t: Tokenizers):
        a, b = t.encode(units)
        data = [u.encode("utf-8", "surrogatepass") for u in units]
        ok = [
            b"".join(map(t.a_bytes.__getitem__, x)) == d and b"".join(map(t.b_bytes.__getitem__, y)) == d
            for x, y, d in zip(a, b, data)
        ]
        self.ok = np.array(ok, bool)
        a, b = [x if k else [] for x, k in zip(a, ok)], [x if k else [] for x, k in zip(b, ok)]
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        ia, ib = (np.fromiter((k for x in ids for k in x), np.int64, int(n.sum())) for ids, n in ((a, self.n_a), (b, self.n_b)))
        end_a, end_b = np.cumsum(t.a_size[ia]), np.cumsum(t.b_size[ib])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        ga, gb = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        na, nb = np.bincount(ga, minlength=len(ends)), np.bincount(gb, minlength=len(ends))
        first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        size = np.array([len(d) if k else 0 for d, k in zip(data, ok)], np.int64)
        of = np.searchsorted(np.cumsum(size), ends) if len(ends) else ends
        self.n_groups = np.bincount(of, minlength=len(units))
        self.n_links = np.bincount(of, weights=(na * nb).astype(np.float64), minlength=len(units)).astype(np.int64)
        # Small groups list their links; of large ones, equal ids are counted first.
        small = na * nb <= DIRECT
        take = np.flatnonzero(small[ga])
        times = nb[ga[take]]
        left, right = np.repeat(take, times), ranges(first_b[ga[take]], times)
        unit, key, n = [of[ga[left]]], [pair_key(ia[left], ib[right], t)], [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(~small).tolist():
            x, nx = np.unique(ia[first_a[g] : first_a[g] + na[g]], return_counts=True)
            y, ny = np.unique(ib[first_b[g] : first_b[g] + nb[g]], return_counts=True)
            key.append(pair_key(np.repeat(x, len(y)), np.tile(y, len(x)), t))
            n.append(np.repeat(nx, len(y)) * np.tile(ny, len(x)))
            unit.append(np.full(len(key[-1]), of[g]))
        unit, key, n = map(np.concatenate, (unit, key, n))
        order = np.lexsort((key, unit))
        unit, key, n = unit[order], key[order], n[order]
        if len(key):
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])]))
            unit, key, n = unit[at], key[at], np.add.reduceat(n, at)
        self.keys, self.times = key, n
        self.count = np.bincount(unit, minlength=len(units)) if len(unit) else np.zeros(len(units), np.int64)
        self.text = self._digits(ia, ib, ga, gb, first_a, first_b, na, nb, of, len(units))

    @staticmethod
    def _digits(ia, ib, ga, gb, first_a, first_b, na, nb, of, n_units) -> list[bytes]:
        """The groups of each unit as a1,a2|b1;a3|b2."""
        total = len(ia) + len(ib)
        ids, mark, group = np.empty(total, np.int64), np.full(total, ord(","), np.uint8), np.empty(total, np.int64)
        at_a, at_b = np.arange(len(ia)) + first_b[ga], np.arange(len(ib)) + (first_a + na)[gb]
        ids[at_a], ids[at_b], group[at_a], group[at_b] = ia, ib, ga, gb
        ends = np.cumsum(na + nb)
        mark[first_a + first_b + na - 1] = ord("|")
        mark[ends - 1] = ord(";")
        digits = np.ones(total, np.int64)
        for power in (10, 100, 1000, 10_000, 100_000, 1_000_000):
            digits += ids >= power
        stop = np.cumsum(digits + 1)
        out = np.empty(int(stop[-1]) if total else 0, np.uint8)
        out[stop - 1] = mark
        rest, k = ids.copy(), 0
        while True:
            live = digits > k
            if not live.any():
                break
            out[stop[live] - 2 - k] = 48 + rest[live] % 10
            rest //= 10
            k += 1
        data = out.tobytes()
        upto = np.zeros(n_units, np.int64)
        last = stop[ends - 1]
        np.maximum.at(upto, of, last)
        upto = np.maximum.accumulate(upto) if n_units else upto
        begin = np.concatenate([[0], upto[:-1]]) if n_units else upto
        return [data[s : max(s, e - 1)] for s, e in zip(begin.tolist(), upto.tolist())]


class UnitCache:
    """What Linked found, by unit; forgotten as a whole when the units grow too long together."""

    FIELDS = ("ok", "n_a", "n_b", "n_groups", "n_links", "count")

    def __init__(self, t: Tokenizers):
        self.t = t
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[bytes] = []
        self.chars = 0
        self.columns = {f: np.zeros(0, np.int64) for f in (*self.FIELDS, "start")}
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.fresh: list[Linked] = []

    def add(self, units: list[str]) -> None:
        """Units that may be known already."""
        if self.chars > CACHE_CHARS:
            self.clear()
        new = [u for u in dict.fromkeys(units) if u not in self.index]
        if not new:
            return
        self.index.update((u, len(self.text) + k) for k, u in enumerate(new))
        self.chars += sum(map(len, new))
        x = Linked(new, self.t)
        self.text += x.text
        c = self.columns
        c["start"] = np.concatenate([c["start"], len(self.keys) + np.cumsum(x.count) - x.count])
        for f in self.FIELDS:
            c[f] = np.concatenate([c[f], getattr(x, f)])
        self.keys, self.times = np.concatenate([self.keys, x.keys]), np.concatenate([self.times, x.times])


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(a.tobytes() for a in arrays))


def pack_pairs(keys: np.ndarray, docs: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=0).astype(np.uint64), docs.astype(np.uint32))


def unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and the number of documents of each."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, np.uint64, n)).astype(np.int64), np.frombuffer(raw, np.uint32, n, 8 * n).astype(np.int64)


def unpack_docs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the records, and how often each holds its pair."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // 6
    return np.frombuffer(raw, np.uint16, n).astype(np.int64), np.frombuffer(raw, np.uint32, n, 2 * n).astype(np.int64)


STATS = ("n_a", "n_b", "n_groups", "n_links")


def _fill_runs(id_type: pa.DataType, byte_path: str, piece_path: str, run_records: int):
    """Rows of documents (p = -1) and of cut runs."""
    schema = pa.schema(
        [("run", pa.string()), ("p", pa.int32()), ("n", pa.int64()), ("pairs", pa.binary()), ("docs", pa.binary()), ("idx", pa.int32()), ("id", id_type)]
        + [(c, pa.int64()) for c in STATS] + [("groups_sha256", pa.string())]
    )

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers_of(byte_path, piece_path)
        cache = UnitCache(t)
        shift = digit_shift(t)
        task = TaskContext.get().partitionId()
        number, n_docs, parts = 0, 0, []

        def name() -> str:
            return f"{task}-{number}"

        def flush() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            keys, times = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys)
            keys, times = keys[order], times[order]
            pair = keys >> 16
            at = np.concatenate([np.searchsorted(pair, np.arange(1 << DIGIT_BITS) << shift), [len(pair)]])
            for p in np.flatnonzero(np.diff(at)).tolist():
                s, e = int(at[p]), int(at[p + 1])
                start = np.flatnonzero(np.concatenate([[True], pair[s + 1 : e] != pair[s : e - 1]]))
                yield rows(
                    1, run=pa.array([name()]), p=pa.array([p], pa.int32()), n=pa.array([e - s], pa.int64()),
                    pairs=pa.array([pack_pairs(pair[s:e][start], np.diff(np.append(start, e - s)))], pa.binary()),
                    docs=pa.array([pack((keys[s:e] & 0xFFFF).astype(np.uint16), times[s:e].astype(np.uint32))], pa.binary()),
                )

        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            low = 0
            while low < len(texts):
                high, chars = low, 0
                while high < len(texts) and high - low < 512 and (high == low or chars + len(texts[high] or "") <= SLICE_CHARS):
                    chars += len(texts[high] or "")
                    high += 1
                if n_docs + high - low > RUN_DOCS or sum(len(k) for k, _ in parts) >= run_records:
                    yield from flush()
                    number, n_docs, parts = number + 1, 0, []
                parts_of = [t.units(x) if x else [] for x in texts[low:high]]
                flat = [u for x in parts_of for u in x]
                cache.add(flat)
                at = np.fromiter(map(cache.index.__getitem__, flat), np.int64, len(flat))
                doc = np.repeat(np.arange(high - low), [len(x) for x in parts_of])
                c = cache.columns
                good = np.bincount(doc, weights=~c["ok"][at].astype(bool), minlength=high - low) == 0
                sure = good[doc]
                stats = {f: np.bincount(doc[sure], weights=c[f][at[sure]].astype(np.float64), minlength=high - low).astype(np.int64) for f in STATS}
                digest, k = [], 0
                for j, x in enumerate(parts_of):
                    whole = b";".join(map(cache.text.__getitem__, at[k : k + len(x)].tolist())) if x and good[j] else b""
                    digest.append(hashlib.sha256(whole).hexdigest() if whole else "")
                    k += len(x)
                yield rows(
                    high - low, run=pa.array([name()] * (high - low)), p=pa.array(np.full(high - low, -1, np.int32)),
                    idx=pa.array(np.arange(n_docs, n_docs + high - low, dtype=np.int32)), id=ids.slice(low, high - low).cast(id_type),
                    groups_sha256=pa.array(digest, pa.string()), **{f: pa.array(v) for f, v in stats.items()},
                )
                u, count = at[sure], c["count"][at[sure]]
                where = ranges(c["start"][u], count)
                parts.append(summed(cache.keys[where] << 16 | np.repeat(doc[sure] + n_docs, count), cache.times[where]))
                n_docs += high - low
                low = high
        yield from flush()

    return run, schema


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merge sorted (keys, counts) runs through a heap: blocks of distinct keys with summed counts.

    The heap holds the last key of each run's next block.  The least of them bounds what can be
    given out: every key up to it lies in the next block of its run.
    """
    at = [0] * len(runs)
    heap = [(int(k[min(block, len(k)) - 1]), r) for r, (k, _) in enumerate(runs) if len(k)]
    heapq.heapify(heap)
    live = {r for _, r in heap}
    while heap:
        bound = heap[0][0]
        keys, counts = [], []
        for r in list(live):
            k, n = runs[r]
            e = at[r] + int(np.searchsorted(k[at[r] : at[r] + block], bound, side="right"))
            if e > at[r]:
                keys.append(k[at[r] : e])
                counts.append(n[at[r] : e])
                at[r] = e
                if e == len(k):
                    live.discard(r)
        while heap and heap[0][0] == bound:
            _, r = heapq.heappop(heap)
            if r in live:
                k = runs[r][0]
                heapq.heappush(heap, (int(k[min(at[r] + block, len(k)) - 1]), r))
        yield summed(np.concatenate(keys), np.concatenate(counts))


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[pa.RecordBatch]]]:
    """((p, salt), its batches) of batches sorted by p and salt, without holding a group."""
    import itertools

    def cuts():
        for b in batches:
            if not b.num_rows:
                continue
            p, s = b.column("p").to_numpy(), b.column("salt").to_numpy()
            at = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])]))
            for x, y in zip(at.tolist(), [*at[1:].tolist(), b.num_rows]):
                yield (int(p[x]), int(s[x])), b.slice(x, y - x)

    for key, group in itertools.groupby(cuts(), key=lambda x: x[0]):
        yield key, (b for _, b in group)


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (p, _), group in _by_group(batches):
        runs = [unpack_pairs(x) for b in group for x in b.column("pairs").to_pylist()]
        for keys, counts in merge_runs(runs):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), p, np.int32)), pa.array(keys), pa.array(counts)], names=["p", "key", "c"]
            )


def _contribute(b_bits: int):
    """Per (run, document): links whose pair is their A id's most frequent, and the sum of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _by_group(batches):
            keys, counts, best = [], [], None
            for b in group:
                is_run = b.column("run").is_valid().to_numpy(zero_copy_only=False)
                n = int((~is_run).sum())  # counts come first
                if n:
                    keys.append(b.column("key").slice(0, n).to_numpy())
                    counts.append(b.column("c").slice(0, n).to_numpy())
                for k in range(n, b.num_rows):
                    if best is None:
                        keys, counts = np.concatenate(keys), np.concatenate(counts)
                        side = keys >> b_bits
                        start = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
                        top = np.repeat(np.maximum.reduceat(counts, start), np.diff(np.append(start, len(keys))))
                        best = counts == top
                    pair, docs = unpack_pairs(b.column("pairs")[k].as_py())
                    doc, times = unpack_docs(b.column("docs")[k].as_py())
                    at = np.repeat(np.searchsorted(keys, pair), docs)
                    order = np.argsort(doc, kind="stable")
                    cut = np.flatnonzero(np.concatenate([[True], np.diff(doc[order]) != 0]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([b.column("run")[k].as_py()] * len(cut), pa.string()), pa.array(doc[order][cut].astype(np.int32)),
                            pa.array(np.add.reduceat((times * best[at])[order], cut)), pa.array(np.add.reduceat((times * counts[at])[order], cut)),
                        ],
                        names=["run", "idx", "n_best", "count_sum"],
                    )

    return run


def align(
    docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY,
    id_col: str = "doc_id", text_col: str = "text", run_records: int = RUN_RECORDS, group_records: int = GROUP_RECORDS,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    documents: id_col, n_a, n_b, n_groups, n_links, n_best (links whose pair's count is the largest
    of its A id), count_sum (of the counts of all links), groups_sha256 (of the groups as
    a1,a2|b1;a3|b2).  pairs: a, b, documents.  Texts that are null or empty, or that a vocabulary
    does not give back byte for byte, have no tokens: zeros and ''.  Rows that repeat an id are
    documents of their own; ids may be of any type, also null.  Other columns are ignored.
    """
    spark = docs.sparkSession
    t = tokenizers_of(byte_vocabulary, piece_vocabulary)
    id_kind = docs.schema[id_col].dataType
    fill, schema = _fill_runs(to_arrow_type(id_kind), byte_vocabulary, piece_vocabulary, run_records)
    ddl = "run string, p int, n bigint, pairs binary, docs binary, idx int, id " + id_kind.simpleString()
    ddl += "".join(f", {c} bigint" for c in STATS) + ", groups_sha256 string"
    rows, _ = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(fill, ddl), "runs")
    runs = rows.filter("p >= 0")
    # One row per digit: at most 2^DIGIT_BITS of them.
    sizes = runs.groupBy("p").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / group_records)).cast("int").alias("salts"))
    sizes, _ = stored(sizes, "digits")
    groups = max(spark.sparkContext.defaultParallelism, int(sizes.agg(F.coalesce(F.sum("salts"), F.lit(1))).first()[0]))
    dealt = runs.join(F.broadcast(sizes), "p").withColumn("salt", F.pmod(F.xxhash64("run"), F.col("salts")).cast("int"))
    partial = (
        dealt.select("p", "salt", "pairs").repartition(groups, "p", "salt").sortWithinPartitions("p", "salt")
        .mapInArrow(_count_runs, "p int, key bigint, c bigint")
    )
    counts, _ = stored(partial.groupBy("p", "key").agg(F.sum("c").alias("c")), "counts")
    copies = counts.join(F.broadcast(sizes), "p").select(
        "p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", "c",
        F.lit(None).cast("string").alias("run"), F.lit(None).cast("binary").alias("pairs"), F.lit(None).cast("binary").alias("docs"),
    )
    records = dealt.select("p", "salt", F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("c"), "run", "pairs", "docs")
    back = (
        copies.unionByName(records).repartition(groups, "p", "salt").sortWithinPartitions("p", "salt", F.col("run").asc_nulls_first(), "key")
        .mapInArrow(_contribute(t.b_bits), "run string, idx int, n_best bigint, count_sum bigint")
        .groupBy("run", "idx").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    found = rows.filter("p < 0").join(back, ["run", "idx"], "left").select(
        F.col("id").alias(id_col), *STATS, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256"
    )
    low, high = t.b_bits, t.a_bits - DIGIT_BITS
    a = F.shiftleft(F.shiftright("key", low).bitwiseAND((1 << high) - 1), DIGIT_BITS).bitwiseOR(F.col("p").cast("bigint"))
    pairs = counts.select(a.alias("a"), F.col("key").bitwiseAND((1 << low) - 1).alias("b"), F.col("c").alias("documents"))
    return found, pairs
