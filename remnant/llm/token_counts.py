"""Token counts by section: whole documents are encoded once, tokens are joined by their spans.

A token covers a span of characters of the document (byte offsets of the encoding mapped to
characters; a token that ends inside a character covers it).  Sections are intervals of the same
characters.  Tokens and sections are joined by overlap inside the document's row: both are
sorted, so the join is two binary searches per token.  A token that crosses a boundary goes to
one section by an explicit rule:

* largest: the section with most of its characters, the earlier of equals;
* first, last: the section with its first or last character that lies in a section.

Sections may leave gaps; tokens in no section are counted as outside.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("largest", "first", "last")


@functools.lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY) -> tuple[tiktoken.Encoding, np.ndarray]:
    """Tokenizer and the number of bytes of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def token_spans(text: str, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of the tokens of a text."""
    enc, size = encoding(path)
    ids = np.fromiter(enc.encode_ordinary(text), np.int64)
    end = np.cumsum(size[ids])
    if not len(end):
        return end, end
    start = end - size[ids]
    if end[-1] == len(text):  # one byte per character
        return start, end
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    of = np.cumsum((data & 0xC0) != 0x80) - 1
    return of[start], of[end - 1] + 1


def allocate(start, end, low, high, rule: str = "largest") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Section of each token (-1: none), and tokens and crossing tokens per section.

    low, high: disjoint sections in order.  Empty sections get nothing.
    """
    section = np.full(len(start), -1, np.int64)
    n, crossing = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
    real = np.flatnonzero(high > low)
    if not len(real) or not len(start):
        return section, n, crossing
    lo, hi = low[real], high[real]
    first = np.searchsorted(hi, start, side="right")
    last = np.searchsorted(lo, end, side="left") - 1
    one = first <= last
    pick = last if rule == "last" else first.copy()
    many = np.flatnonzero(last > first)
    if rule == "largest" and len(many):
        width = last[many] - first[many] + 1
        token = np.repeat(many, width)
        at = np.cumsum(width) - width
        cand = np.arange(width.sum()) - np.repeat(at, width) + np.repeat(first[many], width)
        share = np.minimum(end[token], hi[cand]) - np.maximum(start[token], lo[cand])
        best = np.repeat(np.maximum.reduceat(share, at), width) == share
        spot = np.flatnonzero(best)
        owner, where = np.unique(token[spot], return_index=True)
        pick[owner] = cand[spot[where]]
    section[one] = real[pick[one]]
    n += np.bincount(section[one], minlength=len(low))
    over = np.zeros(len(start), bool)
    over[many] = True
    over &= one
    crossing += np.bincount(section[over], minlength=len(low))
    return section, n, crossing


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sections of a text's lines, each with its line end."""
    points = np.array([ord(c) == 10 for c in text]) if len(text) < 32 else np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10
    cut = np.flatnonzero(points) + 1
    low = np.concatenate([[0], cut]).astype(np.int64)
    return low, np.append(cut, len(text)).astype(np.int64)


def _disjoint(sections: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by start; where two overlap, the characters belong to the earlier one."""
    rows = np.array([(s["start"], s["end"]) for s in sections], np.int64).reshape(-1, 2)
    low, high = np.maximum(rows[:, 0], 0), np.maximum(rows[:, 1], 0)
    reach = np.concatenate([[0], np.maximum.accumulate(high)[:-1]]) if len(high) else high
    low = np.maximum(low, reach)
    return low, np.maximum(high, low)


SCHEMA = "doc_id bigint, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint, n_outside bigint"


def _counter(rule: str, path: str, given: bool):
    def run(batches):
        schema = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])
        for batch in batches:
            for s in range(0, batch.num_rows, 128):
                part = batch.slice(s, 128)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                lists = part.column(2).to_pylist() if given else [None] * len(texts)
                out: list[list] = [[] for _ in schema]
                for doc, text, sections in zip(ids, texts, lists):
                    text = text or ""
                    if given:
                        kept = sorted((x for x in sections or [] if x and None not in (x["section"], x["start"], x["end"])), key=lambda x: (x["start"], x["end"], x["section"]))
                        names = [x["section"] for x in kept]
                        low, high = _disjoint(kept)
                    else:
                        low, high = line_sections(text)
                        names = range(len(low))
                    section, n, crossing = allocate(*token_spans(text, path), low, high, rule)
                    out[0] += [doc] * len(low)
                    out[1] += names
                    for k, v in ((2, low), (3, high), (4, n), (5, crossing)):
                        out[k] += v.tolist()
                    out[6] += [int((section < 0).sum())] * len(low)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    return run


def count_tokens(
    docs: DataFrame, sections: DataFrame | None = None, rule: str = "largest", vocabulary: str = VOCABULARY,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing, n_outside per section of each row.

    sections: doc_id, section (long), start, end in characters; without it, the lines of the
    text.  n_crossing counts those of n_tokens that also touch another section, n_outside the
    tokens of the document in no section.  Null and empty texts are one empty line (with given
    sections: those, with no tokens).  Overlaps belong to the section that starts earlier; rows
    of sections with nulls are ignored.  Rows that repeat an id are counted each.  Other columns
    are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if sections is not None:
        per_doc = sections.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(
            F.collect_list(F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("section", "start", "end")])).alias("s")
        )  # bounded by one document's sections
        rows = rows.join(per_doc, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "s")
    return rows.mapInArrow(_counter(rule, vocabulary, sections is not None), SCHEMA)
