"""Results of runs: visible as a whole, replaced as a whole."""

import os

import pytest
from pyspark.sql import functions as F

from remnant.streaming import results as R

SCHEMA = "item bigint, run string"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def seen(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return sorted(((r.run, r.item) for r in R.read_runs(spark, path, schema).collect()), key=str)


@pytest.fixture
def path(spark, tmp_path):
    out = str(tmp_path / "runs")
    R.publish_runs(table(spark, (1, "a"), (2, "a"), (3, "b"), (4, None)), out, "1")
    return out


def test_nothing_written(spark, tmp_path):
    assert seen(spark, str(tmp_path / "none")) == []


def test_rerun_replaces_its_runs_only(spark, path):
    assert R.publish_runs(table(spark, (9, "a"), (8, None)), path, "2") == "2"
    assert seen(spark, path) == sorted([("a", 9), ("b", 3), (None, 8)], key=str)
    got = {r.run: (r.version, r.n_rows, r.seq) for r in R.latest_runs(spark, path).collect()}
    assert got == {"a": ("2", 1, 2), "b": ("1", 1, 1), None: ("2", 1, 2)}


def test_rerun_without_rows_empties_its_run(spark, path):
    R.publish_runs(table(spark).limit(0), path, "2", runs=spark.createDataFrame([("a",)], "run string"))
    assert seen(spark, path) == sorted([("b", 3), (None, 4)], key=str)


def test_failed_task_leaves_nothing(spark, path):
    before = seen(spark, path)
    many = spark.range(0, 4000, 1, 4).select(
        F.when(F.col("id") == 3999, F.raise_error(F.lit("stop")).cast("bigint")).otherwise(F.col("id")).alias("item"), F.lit("a").alias("run")
    )
    with pytest.raises(Exception, match="stop"):
        R.publish_runs(many, path, "2")
    assert seen(spark, path) == before
    assert len([n for n in os.listdir(f"{path}/data") if n.startswith("attempt=")]) == 1
    assert [n for n in os.listdir(f"{path}/manifests")] == ["seq=1"]


def test_killed_before_its_manifest(spark, path):
    """A driver that dies after the rows are written leaves an attempt without manifest."""
    before = seen(spark, path)
    table(spark, (7, "a")).write.partitionBy("run").json(f"{path}/data/attempt=lost")
    table(spark, (7, "a")).write.parquet(f"{path}/manifests/.lost")
    assert seen(spark, path) == before
    assert R.publish_runs(table(spark, (6, "a")), path, "2") == "2"
    assert ("a", 6) in seen(spark, path) and ("a", 7) not in seen(spark, path)


def test_writers_that_meet_take_the_next_number(spark, path, monkeypatch):
    rival = table(spark, (5, "a"))
    publish, met = R._publish, []

    def late(s, staged, manifests):
        if not met:
            met.append(1)
            # Another writer takes the number between the listing and the rename.
            listed = max
            monkeypatch.setattr("builtins.max", lambda *a, **k: (monkeypatch.setattr("builtins.max", listed), R.publish_runs(rival, path, "2"), listed(*a, **k))[2])
        return publish(s, staged, manifests)

    monkeypatch.setattr(R, "_publish", late)
    assert R.publish_runs(table(spark, (6, "a")), path, "3") == "3"
    assert [x for x in seen(spark, path) if x[0] == "a"] == [("a", 6)]


def test_lost_rows_are_found(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    rows, valid = R.read_runs(spark, path, schema), R.latest_runs(spark, path)
    assert R.incomplete_runs(rows, valid).count() == 0
    lost = R.incomplete_runs(rows.filter("item <> 2 and run is not null"), valid).collect()
    assert sorted([(r.run, r.n_rows, r.n_found) for r in lost], key=str) == sorted([("a", 2, 1), (None, 1, 0)], key=str)
