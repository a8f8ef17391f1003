"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned from a bounded labelled sample: words that occur in many more toxic than
other documents, and in many different contexts, so that one text copied often adds none.  Each
text then has dense features: lexicon densities, also after undoing disguises such as l0ser or
i-d-i-o-t, the distance of lexicon words to second-person words, capitals, marks and disguise
rates.  Boosted trees (MLlib) give a raw probability, and an isotonic curve fitted on rows kept
from the trees turns it into a calibrated score.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remnant.llm.common import bounded_labels, text_udf, uniform
from remnant.sources.storage import materialize

LABELLED = 12_000  # labelled documents used, about, at most
LEXICON = 2_000  # words, at most
MIN_CONTEXTS = 8
MIN_RATIO = 8.0
TREES = 12
DEPTH = 3
SEED = 4
NEAR = 12  # words

#: Second-person words of four languages, and digits and signs read as letters.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie usted ustedes vosotros ti tus"
READ_AS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_TOKEN = re.compile(r"\S+")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»…“”‘’"
_PERSONS = frozenset(SECOND_PERSON.split())
_PLAIN = {ord(k): v for k, v in READ_AS.items()} | {ord(c): None for c in "-_.*'`~^+=|/\\"}
_DISGUISE = re.compile(r"[^\W\d_][0-9@$!*_.\-]+[^\W\d_]")

FEATURES = (
    "log_words", "lexicon_rate", "lexicon_hits", "lexicon_kinds", "plain_rate", "plain_hits", "near_person",
    "person_rate", "most_in_window", "capital_rate", "mark_rate", "mark_runs", "disguise_rate", "weight_sum",
)
DDL = ", ".join(f"{f} double" for f in FEATURES)


def tokens(text: str | None) -> list[str]:
    """Lower-cased words without signs at their edges."""
    return [t for t in (w.strip(_EDGE) for w in (text or "").lower().split()) if t]


def plain(token: str) -> str:
    """A word with digits and signs read as letters."""
    return token.translate(_PLAIN)


def features_of(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """Dense features of one whole text; all zero without words."""
    low = tokens(text)
    if not low:
        return [0.0] * len(FEATURES)
    n = len(low)
    hits = [i for i, w in enumerate(low) if w in lexicon]
    odd = [i for i, w in enumerate(low) if not w.isalpha()]
    hidden = [i for i in odd if low[i] not in lexicon and plain(low[i]) in lexicon]
    # Letters spelled one by one: l o s e r.
    runs, start = [], None
    for i in [*[k for k, w in enumerate(low) if len(w) == 1], n + 1]:
        if start is not None and i != last + 1:
            runs.append("".join(low[start : last + 1]))
            start = None
        if start is None:
            start = i
        last = i
    hidden_runs = sum(1 for r in runs if len(r) > 3 and r in lexicon)
    persons = np.array([i for i, w in enumerate(low) if w in _PERSONS])
    near = 0
    if hits and len(persons):
        h = np.array(hits)
        at = np.searchsorted(persons, h)
        before = h - persons[np.maximum(at - 1, 0)]
        after = persons[np.minimum(at, len(persons) - 1)] - h
        near = int(((np.abs(before) <= NEAR) | (np.abs(after) <= NEAR)).sum())
    most = 0
    every = np.sort(np.array(hits + hidden, np.int64))
    if len(every):
        most = int((np.searchsorted(every, every + 20) - np.arange(len(every))).max())
    data = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    letters = max(1, int(data[65:91].sum() + data[97:123].sum()))
    marks = int(data[33] + data[63])
    disguised = sum(1 for i in odd if _DISGUISE.search(low[i]))
    return [
        math.log1p(n), len(hits) / n, float(len(hits)), float(len({low[i] for i in hits})), (len(hits) + len(hidden) + hidden_runs) / n,
        float(len(hits) + len(hidden) + hidden_runs), near / max(1, len(hits)), len(persons) / n, float(most),
        float(data[65:91].sum()) / letters, marks / n, float(len(re.findall(r"[!?]{2,}", text))) / n, disguised / n,
        math.fsum(lexicon[low[i]] for i in hits) + math.fsum(lexicon[plain(low[i])] for i in hidden),
    ]


def features(text: Column, lexicon: dict[str, float]) -> Column:
    def run(texts: list) -> dict:
        rows = [features_of(t, lexicon) for t in texts]
        return {f: [r[k] for r in rows] for k, f in enumerate(FEATURES)}

    return text_udf(run, DDL)(text.cast("string"))


def _word_rows(batches):
    """Distinct words of each text with a hash of the words around the first occurrence."""
    for batch in batches:
        for s in range(0, batch.num_rows, 128):
            ys = batch.column(1).slice(s, 128).to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for y, text in zip(ys, batch.column(0).slice(s, 128).to_pylist()):
                low = tokens(text)
                first = {w: i for i, w in reversed(list(enumerate(low)))}
                for w, i in first.items():
                    around = f"{low[i - 1] if i else ''} {low[i + 1] if i + 1 < len(low) else ''}"
                    out[0].append(w)
                    out[1].append(y)
                    out[2].append(xxhash.xxh64_intdigest(around) >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], ["word", "y", "context"])


def learn_lexicon(texts: DataFrame, words_bound: int = LEXICON) -> dict[str, float]:
    """Words and their log ratios; texts: text, y (the labelled sample)."""
    n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return {}
    rows = texts.select("text", "y").mapInArrow(_word_rows, "word string, y int, context bigint")
    contexts = rows.groupBy("word", "y", "context").agg(F.count(F.lit(1)).alias("n"))
    counts = contexts.groupBy("word").agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("q")
    )
    ratio = F.log((F.col("p") + 0.1) / float(bad)) - F.log((F.col("q") + 0.5) / float(good))
    top = (
        counts.filter(F.col("p") >= MIN_CONTEXTS).withColumn("w", ratio).filter(F.col("w") >= math.log(MIN_RATIO))
        .orderBy(F.col("w").desc(), F.col("p").desc(), "word").limit(words_bound).collect()
    )
    return {r["word"]: r["w"] for r in top}


def train(texts: DataFrame):
    """(lexicon, trees, curve) from a labelled sample doc_id, text, y; None without both labels.

    A fifth of the sample, drawn by id, fits the curve; the rest the lexicon and the trees.
    """
    texts = materialize(texts.withColumn("fold", F.floor(uniform(SEED + 1, F.col("doc_id")) * 5)))
    both = {r["y"] for r in texts.filter("fold > 0").select("y").distinct().collect()}
    if both != {0, 1}:
        return None
    lexicon = learn_lexicon(texts.filter("fold > 0"))
    rows = materialize(texts.select("doc_id", "fold", F.col("y").cast("double").alias("label"), features(F.col("text"), lexicon).alias("f")).select("doc_id", "fold", "label", "f.*"))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("doc_id", "fold", "label", "features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, maxBins=32).fit(rows.filter("fold > 0").coalesce(4))
    held = trees.transform(rows.filter("fold = 0"))
    held = held.select("label", vector_to_array("probability")[1].alias("p"))
    if held.isEmpty():
        return lexicon, trees, None
    curve = IsotonicRegression(labelCol="label", featuresCol="p", predictionCol="score").fit(held)
    return lexicon, trees, curve


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score in [0, 1] per row of docs.

    Null and empty texts have zero features and a score like any other.  Without a model (no
    labels of both kinds) the score is 0.  Other columns are ignored.
    """
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    lexicon, trees, curve = model
    rows = docs.select("doc_id", features(F.col("text"), lexicon).alias("f")).select("doc_id", "f.*")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("doc_id", "features")
    rows = trees.transform(rows).select("doc_id", vector_to_array("probability")[1].alias("p"))
    if curve is None:
        return rows.withColumnRenamed("p", "score")
    return curve.transform(rows).select("doc_id", F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def labelled(docs: DataFrame, labels: DataFrame, where: Column | None = None, bound: int = LABELLED) -> DataFrame:
    """The labelled sample doc_id, text, y; of rows that repeat an id the least text counts."""
    sample = materialize(bounded_labels(labels, "toxic", bound, SEED, where))
    # The sample has about `bound` rows of two numbers, so that it can be sent to every task.
    mine = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return mine.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))
