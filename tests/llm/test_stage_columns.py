"""The four document stages return every column of their input, whatever its name."""

import pytest
from pyspark.sql import functions as F

from remnant.llm import mixing, quality_classifier, quality_rules, simhash_dedup

TAKEN = [
    "_s", "s", "_key", "key", "_row", "row", "_fp", "fp", "_id", "id", "_null", "_text", "_size", "size", "_source", "_source_size", "source_size", "_target",
    "target", "_last", "last", "_taken", "taken", "own", "doc", "copies", "one", "h", "n", "class", "component", "component_id", "node", "kept", "rule", "base_failed",
    "importance", "n_grams", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fingerprint", "place", "y", "all", "cum", "time", "with.dot",
]


@pytest.fixture(scope="module")
def tables(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in TAKEN})
    return docs, spark.read.parquet(f"{path}/labels.parquet")


@pytest.mark.parametrize("stage", ["sampled", "good", "one", "mixed"])
def test_columns_come_back(tables, stage):
    docs, labels = tables
    run = {
        "sampled": lambda d: quality_classifier.keep_sampled(d, labels), "good": lambda d: quality_rules.keep_good(d, labels),
        "one": simhash_dedup.keep_one, "mixed": mixing.mixed_documents,
    }[stage]
    out = run(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    given = {r["doc_id"]: tuple(r) for r in docs.collect()}
    got = out.collect()
    assert got and all(tuple(r) == given[r["doc_id"]] for r in got)
    plain = run(docs.select("doc_id", "text", "lang", "source", "n_chars")).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in plain)
