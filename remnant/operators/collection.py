"""From result documents to one table of metrics per data set and method."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from remnant.functions import fixed_values as V
from remnant.functions import kernels
from remnant.functions import text as T
from remnant.sources.documents import candidate_rows, flatten


def leaf_score(key: str, aliases: list[str]) -> int:
    """100 for an equal key, 90 for the suffix `_alias`, 50 for a substring, else 0."""
    names = [a.replace("-", "_") for a in aliases]
    if key in names:
        return 100
    if any(key.endswith("_" + n) for n in names):
        return 90
    return 50 if any(n in key for n in names) else 0


_NAMED = (
    StructType().add("nkey", StringType()).add("leaf", StringType()).add("scores", ArrayType(IntegerType()))
)


@arrow_udf(_NAMED)
def _named(keys: pa.Array) -> pa.Array:
    """Normalized key and last name, and a score by metric; once per distinct key of a batch."""
    coded = keys.dictionary_encode()
    names = coded.dictionary.to_pylist()
    nkeys = [kernels.norm_token(k) for k in names]
    scores = [[leaf_score(k, al) for al in V.METRIC_ALIASES.values()] for k in nkeys]
    columns = [
        pa.array(nkeys, pa.string()), pa.array([kernels.norm_token(k.rsplit(".", 1)[-1]) for k in names], pa.string()),
        pa.array(scores, pa.list_(pa.int32())),
    ]
    return pa.StructArray.from_arrays(columns, ["nkey", "leaf", "scores"]).take(coded.indices)


def _numbered(leaves: DataFrame) -> DataFrame:
    """leaves with nkey, leaf, scores and number."""
    # Called non-deterministic, so that a later filter on its result doesn't run it again.
    number = F.when(F.col("type") != "boolean", T.parse_number("value"))
    return leaves.select("*", number.alias("number"), _named.asNondeterministic()(F.col("key")).alias("_n")).select(
        *leaves.columns, "number", "_n.*"
    )


def extract_metrics(leaves: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Best numeric leaf per metric: highest score, then shortest key, then key text.

    The chosen key and its score are kept, so that weak substring matches stay visible.
    """
    keys = keys or ["source_file", "row_id"]
    named = _numbered(leaves).filter(F.col("number").isNotNull())
    scored = F.transform(
        F.array(*[F.lit(m) for m in V.METRIC_ALIASES]),
        lambda m, i: F.struct(m.alias("metric"), F.get("scores", i).alias("score")),
    )
    hits = named.select(
        *keys, "nkey", "number", F.explode(F.filter(scored, lambda s: s["score"] > 0)).alias("s")
    )
    best = F.min_by(
        F.struct("number", "nkey", F.col("s.score").alias("score")),
        F.struct(-F.col("s.score"), F.length("nkey"), "nkey", "number"),
    )
    return hits.groupBy(*keys, F.col("s.metric").alias("metric")).agg(best.alias("b")).select(
        *keys, "metric", F.col("b.number").alias("value"), F.col("b.nkey").alias("matched_key"),
        F.col("b.score").alias("score"),
    )


def _leaf_value(names: list[str]) -> Column:
    """Value of the leaf with one of the names; the shortest path wins."""
    hit = F.col("leaf").isin(*names)
    return F.min_by(F.when(hit, F.col("value")), F.when(hit, F.struct(F.length("key"), "key")))


def collect_rows(docs: DataFrame, strict_seed: bool = False) -> DataFrame:
    """Result rows of the documents: dataset, method, seed, source_file, container, metrics.

    One pass over the documents and one aggregation of their leaves per row.
    """
    keys = ["source_file", "row_id", "container_key"]
    leaves = flatten(candidate_rows(docs), keep=keys)
    label = F.col("leaf").isin(*V.DATASET_KEYS, *V.METHOD_KEYS, *V.SEED_KEYS)
    # Only numbers under a known name and label leaves take part in the aggregation.
    metric = F.col("number").isNotNull() & (F.array_max("scores") > 0)
    named = _numbered(leaves).filter(label | metric)
    place = {m: i for i, m in enumerate(V.METRIC_ALIASES)}

    def best(metric: str) -> Column:
        score = F.get("scores", F.lit(place[metric]))
        rank = F.struct(-score, F.length("nkey"), F.col("nkey"), F.col("number"))
        return F.min_by("number", F.when((score > 0) & F.col("number").isNotNull(), rank)).alias(metric)

    wide = named.groupBy(*keys).agg(
        _leaf_value(V.DATASET_KEYS).alias("d"), _leaf_value(V.METHOD_KEYS).alias("m"),
        _leaf_value(V.SEED_KEYS).alias("s"), *[best(m) for m in V.METRICS],
    )
    path, box = F.col("source_file"), F.col("container_key")
    found = wide.withColumns(
        {
            "dataset": T.canonical_dataset(F.col("d"), path, box),
            "method": T.canonical_method(F.col("m"), path, box),
            "seed": T.infer_seed(path, F.col("s"), strict=strict_seed),
        }
    )
    usable = F.col("dataset").isNotNull() & F.col("method").isNotNull() & (metric_count(V.METRICS) > 0)
    return found.filter(usable).select(
        "dataset", "method", "seed", "source_file", "row_id", "container_key", *V.METRICS
    )


def metric_count(metrics: list[str]) -> Column:
    return sum((F.col(m).isNotNull().cast("int") for m in metrics), F.lit(0))


def dedupe_richest(rows: DataFrame, metrics: list[str], position: str = "row_id") -> DataFrame:
    """Row with most metrics per (dataset, method, seed, source); the first on ties."""
    keys = ["dataset", "method", "seed", "source_file"]
    other = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*other), F.struct(-metric_count(metrics), position))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col("b")[c].alias(c) for c in other])


def aggregate_results(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric per data set and method, with the numbers of seeds and sources.

    `result_sources` has the seeds and sources themselves.
    """
    keys = ["dataset", "method"]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(m).alias(m) for m in metrics],
        F.count_distinct("seed").alias("n_seeds"), F.count_distinct("source_file").alias("n_source_files"),
    )


def result_sources(rows: DataFrame) -> DataFrame:
    return rows.select("dataset", "method", "seed", "source_file").distinct()


def wide_table(agg: DataFrame, metrics: list[str], datasets: list[str] | None = None) -> DataFrame:
    """One row per method, one column per data set and metric, plus row counts and seeds."""
    datasets = datasets or list(V.DATASET_ALIASES)
    cells = [
        F.max(F.when(F.col("dataset") == d, F.col(c))).alias(f"{d}__{c}")
        for d in datasets
        for c in [*metrics, "n_rows", "n_seeds"]
    ]
    return agg.groupBy("method").agg(*cells)


def coverage(agg: DataFrame, datasets: list[str] | None = None) -> DataFrame:
    """Number of methods of each data set and of all of them, and the overall verdict."""
    datasets = datasets or list(V.DATASET_ALIASES)
    present = agg.select("dataset", "method").distinct()
    everywhere = present.groupBy("method").agg(
        F.count_if(F.col("dataset").isin(*datasets)).alias("k")
    ).filter(F.col("k") == len(datasets)).select("method")
    def count(df: DataFrame, c: Column) -> Column:
        return df.agg(c).scalar()

    n_in_all = count(everywhere, F.count(F.lit(1)))
    found = count(present, F.countDistinct("dataset"))
    verdict = (
        F.when(F.col("found") == 0, "FAIL")
        .when((F.col("found") < 2) | (F.col("n_in_all") == 0), "WARN").otherwise("PASS")
    )
    names = present.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_methods"))
    base = agg.sparkSession.createDataFrame([(d,) for d in datasets], "dataset string")
    return base.join(names, "dataset", "left").withColumns({"n_in_all": n_in_all, "found": found}).select(
        "dataset", F.coalesce("n_methods", F.lit(0)).alias("n_methods"), "n_in_all", verdict.alias("verdict")
    )


def dataset_methods(agg: DataFrame) -> DataFrame:
    """The methods behind `coverage`, one row each."""
    return agg.select("dataset", "method").distinct()


def source_inventory(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per file: matched, unmatched or unreadable, with its metric count."""
    matched = rows.groupBy("source_file").agg(F.max(metric_count(V.METRICS)).alias("metric_count"))
    status = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("metric_count").isNotNull(), "matched").otherwise("unmatched")
    )
    return docs.join(matched, "source_file", "left").select(
        "source_file", "size_bytes", status.alias("status"),
        F.coalesce("metric_count", F.lit(0)).alias("metric_count"), "error",
    )


def unmatched(inventory: DataFrame) -> DataFrame:
    return inventory.filter(F.col("status") != "matched")
