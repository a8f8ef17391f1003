"""Quality by importance resampling: how much likelier a text is in good text than in all.

Two generative models over hashed word unigrams and bigrams: one of the target (documents
labelled good, a bounded sample) and one of the raw text (all documents).  The importance of a
document is the mean log ratio of the two over its n-grams; the mean, so that length alone does
not decide.  Documents are sampled without replacement by Gumbel top-k: the key is
SHARPNESS * importance plus a Gumbel number drawn from the document's id, and the k largest keys
stay.  k is the number of documents that the labels call good: those at or above the importance
that best separates labelled documents which the target model has not seen.  For that, a
fifth of the documents labelled good is held back from the target model; with the documents
labelled bad it chooses the cut.
"""

from __future__ import annotations

from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remnant.llm.common import WORD, bounded_labels, text_udf, uniform, words
from remnant.sources.storage import materialize

BUCKETS = 1 << 17
LABELLED = 20_000  # labelled documents used, about, at most
SMOOTH = 0.5
SHARPNESS = 60.0
SEED = 6
BINS = 4096


def grams(text: str | None, buckets: int) -> np.ndarray:
    """Bucket of each word and of each two words in a row."""
    w = words(text)
    if not w:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(crc32, w), np.uint64, len(w))
    one = h * np.uint64(0x9E3779B97F4A7C15)
    two = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)) ^ (h[1:] * np.uint64(0x165667B19E3779F9))
    two *= np.uint64(0x9E3779B97F4A7C15)
    return (np.concatenate([one, two]) >> np.uint64(40)).astype(np.int64) % buckets


class Model(NamedTuple):
    weight: np.ndarray  # log ratio by bucket
    cut: float  # importance that best separates labelled documents outside the fit


def _counter(good: np.ndarray, buckets: int):
    def run(batches):
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            target = np.isin(ids, good)
            for s in range(0, batch.num_rows, 256):
                for k, text in enumerate(batch.column(1).slice(s, 256).to_pylist()):
                    b = grams(text, buckets)
                    np.add.at(counts[0], b, 1)
                    if target[s + k]:
                        np.add.at(counts[1], b, 1)
        for kind in (0, 1):
            at = np.flatnonzero(counts[kind])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[kind][at])],
                ["kind", "bucket", "n"],
            )

    return run


def log_ratio(docs: DataFrame, good_ids: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of the target and raw model by bucket; the raw model counts every document.

    Only bucket totals (2 * buckets numbers) reach the driver.
    """
    good = np.sort(np.asarray(good_ids, np.int64))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 62))).alias("doc_id"), F.col("text").cast("string").alias("text"))
    sums = (
        rows.mapInArrow(_counter(good, buckets), "kind int, bucket int, n bigint")
        .groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    n = np.zeros((2, buckets))
    n[sums["kind"].to_numpy(), sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    p = (n + SMOOTH) / (n + SMOOTH).sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def importance(text: Column, weight: np.ndarray) -> Column:
    """Struct (n_grams, importance) of a text; null without words."""
    table = weight.astype(np.float32)

    def run(texts: list) -> dict:
        n, mean = [], []
        for t in texts:
            b = grams(t, len(table))
            n.append(len(b))
            mean.append(float(table[b].mean(dtype=np.float64)) if len(b) else None)
        return {"n_grams": n, "importance": mean}

    return text_udf(run, "n_grams bigint, importance double")(text.cast("string"))


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The cut with the largest sum of the two classes' hit rates; the lowest of ties.

    Without both classes there is nothing to separate and everything passes.
    """
    if not len(y) or y.min() == y.max():
        return -np.inf
    order = np.argsort(score, kind="stable")
    s, t = score[order], y[order]
    lost = np.concatenate([[0], np.cumsum(t)]) / max(1, t.sum())
    caught = np.concatenate([[0], np.cumsum(1 - t)]) / max(1, (1 - t).sum())
    gain = caught - lost
    gain[1:-1][s[1:] == s[:-1]] = -1  # never between equal scores
    at = int(np.argmax(gain))
    if at == len(s):
        return np.inf
    return float(s[at] if at == 0 else (s[at] + s[at - 1]) / 2)


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by counting in bins that narrow; -inf if there are fewer."""
    if k <= 0:
        return float("inf")
    lo, hi, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < k or lo is None:
        return float("-inf")
    above = 0
    rows = keys.select(F.col(column).alias("v")).filter("v is not null")
    while True:
        inside = rows.filter((F.col("v") >= lo) & (F.col("v") <= hi))
        step = (hi - lo) / BINS
        if step <= 0 or lo + step == lo:
            return lo
        slot = F.least(F.floor((F.col("v") - lo) / step), F.lit(BINS - 1)).cast("int")
        got = {r["b"]: r for r in inside.groupBy(slot.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        for b in sorted(got, reverse=True):
            if above + got[b]["n"] >= k:
                break
            above += got[b]["n"]
        lo, hi, n = got[b]["lo"], got[b]["hi"], got[b]["n"]
        if lo == hi:
            return lo
        if n <= BINS:
            top = inside.filter((F.col("v") >= lo) & (F.col("v") <= hi)).orderBy(F.col("v").desc()).limit(k - above).collect()
            return top[-1]["v"]


def gumbel(doc_id: Column) -> Column:
    return -F.log(-F.log(uniform(SEED, doc_id.cast("string"))))


def split_good(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fitted, held back): every fifth id in the order of a hash is held back, one at least.

    A single id is in both, as there is nothing else to fit or to choose the cut on.
    """
    ids = np.sort(np.asarray(good, np.int64))
    ids = ids[np.argsort([crc32(f"{SEED}:{i}".encode()) for i in ids.tolist()], kind="stable")]
    back = np.arange(len(ids)) % 5 == 0
    return (ids[~back], ids[back]) if len(ids) > 1 else (ids, ids)


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, buckets: int = BUCKETS) -> tuple[np.ndarray, DataFrame]:
    """Weights by bucket, and the labelled documents (doc_id, y) to choose the cut on.

    The target model counts documents with words only, and each part has some of those.
    """
    sample = materialize(bounded_labels(labels, "quality", bound, SEED))
    worded = docs.filter(F.col("text").cast("string").rlike(WORD)).select(F.col("doc_id").cast("bigint").alias("doc_id"))
    good = sample.filter("y = 1").join(worded, "doc_id", "left_semi").select("doc_id").collect()
    fitted, held = split_good(np.array([r["doc_id"] for r in good], np.int64))
    known = sample.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(held, pa.int64())}))
    unseen = sample.filter("y = 0").unionByName(sample.filter("y = 1").join(known, "doc_id", "left_semi"))
    return log_ratio(docs, fitted, buckets), unseen


def resample(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, buckets: int = BUCKETS):
    """(scores, weight, threshold): scores has doc_id, n_grams, importance, key, kept per row.

    Null, empty and blank texts have no n-grams, a null importance and are not sampled.  A null
    id draws the Gumbel number of an empty one; rows that repeat an id share their draw.  All
    rows whose key equals the k-th largest are kept.  Without good or without bad labels
    everything with words is kept.  Other columns of docs are ignored.
    """
    weight, unseen = fit(docs, labels, bound, buckets)
    rows = docs.select("doc_id", importance(F.col("text"), weight).alias("s")).select("doc_id", "s.*")
    rows = materialize(rows.withColumn("key", key_of(F.col("importance"), F.col("doc_id"))))
    # Of rows that repeat an id the least counts, so that the sample stays bounded.
    known = rows.filter("importance is not null").join(unseen, "doc_id").groupBy("doc_id", "y").agg(F.min("importance").alias("importance")).toPandas()
    cut = best_cut(known["importance"].to_numpy(float), known["y"].to_numpy(int))
    k = rows.filter(F.col("importance") >= F.lit(float(cut))).count()
    least = kth_largest(rows, "key", k)
    kept = F.coalesce(F.col("key") >= F.lit(float(least)), F.lit(False))
    return rows.withColumn("kept", kept), weight, least


def key_of(value: Column, doc_id: Column) -> Column:
    return SHARPNESS * value + gumbel(F.coalesce(doc_id.cast("string"), F.lit("")))


def keep_sampled(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the resampling keeps, with the columns of docs."""
    _, weight, least = resample(docs, labels, **options)
    value = importance(F.col("text"), weight)["importance"]
    rows = docs.select(F.struct("*").alias("row"), key_of(value, F.col("doc_id")).alias("key"))
    return rows.filter(F.col("key") >= F.lit(float(least))).select("row.*")
