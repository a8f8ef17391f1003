"""Sources and collection on small files written by the tests."""

import json

import pytest
from pyspark.sql import functions as F

from remnant.operators import collection as G
from remnant.sources import documents as D
from remnant.sources import items as I
from remnant.sources import sinks
from remnant.sources.files import index_files
from remnant.streaming.incremental import pending_runs, write_run


def write(path, obj):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(obj if isinstance(obj, str) else json.dumps(obj), encoding="utf-8")


def docs(spark, *objs):
    rows = [(f"/d/{i}.json", 1, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objs)]
    return D.parse_docs(spark.createDataFrame(rows, "source_file string, size_bytes long, text string"))


def test_flat_items(spark, tmp_path):
    write(tmp_path / "annotations.json", [
        {"image": "a.jpg", "question": "q1", "gt": "g", "name": "Ann Lee"},
        {"image": "/x/b.jpg", "question": "q2", "answer": "", "gt": "g", "entity": "E", "aliases": ["z"]},
        {"question": "no image", "answer": "x"}, {"image": "c.jpg", "question": "q3"},
    ])
    got = {r.question: r for r in I.read_items(spark, str(tmp_path), "d", "forget").collect()}
    assert set(got) == {"q1", "q2", "q3"}
    assert got["q1"].entity == "Ann Lee" and got["q1"].answer == "g" and got["q1"].image.endswith("/a.jpg") and "Lee" in got["q1"].aliases
    assert got["q2"].answer == "" and got["q2"].image == "/x/b.jpg" and got["q2"].aliases == ["z"] and got["q3"].entity == "unknown"


def test_folder_items(spark, tmp_path):
    qa = [{"question": "q1", "answer": "a1"}, {"question": "q2", "gt": "a2"}]
    for e, files in {"e1": {"b.json": qa}, "e2": {"a.json": {"question": "no"}, "qa.json": {"question": "q3", "answer": "x", "entity": "Own"}}, "noimg": {"qa.json": qa}, "nojson": {}}.items():
        (tmp_path / e).mkdir()
        for name, obj in files.items():
            write(tmp_path / e / name, obj)
        if e != "noimg":
            (tmp_path / e / "z.png").write_bytes(b"1")
    (tmp_path / "e1" / "y.jpg").write_bytes(b"1")
    got = {r.question: r for r in I.read_items(spark, str(tmp_path), layout="folders").collect()}
    assert set(got) == {"q1", "q2", "q3"}
    assert got["q1"].entity == "e1" and got["q1"].image.endswith("y.jpg") and got["q2"].answer == "a2" and got["q3"].entity == "Own"


def test_json_or_lines(spark, tmp_path):
    write(tmp_path / "whole.json", [{"a": 1}])
    write(tmp_path / "lines.jsonl", '{"a": 1}\n\n{"a": 2}\n{bad\n')
    rows = D.read_json_or_jsonl(spark, str(tmp_path)).collect()
    assert sorted((r.source_file.split("/")[-1], r.line_no, r.error) for r in rows if r.line_no) == [
        ("lines.jsonl", 1, None), ("lines.jsonl", 3, None), ("lines.jsonl", 4, "invalid JSON at line 4"),
    ]
    assert sum(r.line_no is None for r in rows) == 1
    strict = D.read_jsonl(spark, str(tmp_path / "lines.jsonl"))
    assert strict.filter("error IS NOT NULL").count() == 1 and strict.count() == 3


def test_unwrap(spark):
    d = docs(spark, [{"n": 1}, 5], {"items": [{"n": 2}]}, {"k": {"n": 3}, "x": 1}, {"data": {"n": 9}}, "{broken", {"x": 1})
    got = D.unwrap_records(d).select("source_file", F.try_variant_get("record", "$.n", "int").alias("n"), "source_key").collect()
    assert sorted((r.n, r.source_key) for r in got) == [(1, None), (2, None), (3, "k"), (9, "data")]


def test_flatten_and_depth(spark):
    d = docs(spark, {"a": {"b": [1, "x", None], "c": {"d": 1.5}}, "long": list(range(11)), "nested": [{"z": 1}], "t": True, "n": None, "empty": {}})
    rows = D.candidate_rows(d)
    got = {r.key: (r.value, r.type) for r in D.flatten(rows).collect()}
    assert set(got) == {"a.b", "a.c.d", "t", "n"} and got["t"] == ("true", "boolean") and got["n"][0] is None


def test_depth_has_no_limit(spark):
    leaf = {"name": "e", "property": "P1", "label": "L", "output": "r"}
    deep = leaf
    for i in range(60):
        deep = {"k": deep} if i % 2 else [deep]
    rows = D.candidate_rows(docs(spark, {"x": 1, "a": {"k": {"k": {"k": 2.50}}}}, {"d": deep}))
    assert {r.key: r.value for r in D.flatten(rows).collect() if r.key in ("x", "a.k.k.k")} == {"x": "1", "a.k.k.k": "2.5"}
    nested = 1
    for _ in range(60):
        nested = {"k": nested}
    assert [r.key for r in D.flatten(D.candidate_rows(docs(spark, nested))).collect()] == [".".join(["k"] * 60)]
    found = D.find_records(docs(spark, {"d": deep})).collect()
    assert [r.entity for r in found] == ["e"] and found[0].json_path.count("[0]") == 30


def test_find_records(spark):
    probe = {"name": "e", "property": "P1", "label": "L", "output": "r", "aliases": ["x"], "score": 0.5}
    d = docs(spark, {"outer": {"list": [probe, {"name": "no"}], "deep": {**probe, "inner": probe}}}, {**probe, "output": None})
    got = {r.json_path: r for r in D.find_records(d).collect()}
    assert set(got) == {"outer.list[0]", "outer.deep", "outer.deep.inner"}
    r = got["outer.list[0]"]
    assert (r.entity, r.relation, r.label, r.response, r.aliases, r.score) == ("e", "P1", "L", "r", '["x"]', "0.5")


def test_entity_values(spark):
    d = docs(spark, {"per_entity": {"a": {"lb": 1, "ve_mean": 0.5, "br_mean": 0.1}, "b": {"bridge": 2}, "c": 3}})
    assert sorted((r.entity, r.ve, r.br, r.lb) for r in D.read_entity_values(d).collect()) == [("a", 0.5, 0.1, 1.0), ("b", None, 2.0, None)]


def test_scan_and_collect(spark, tmp_path):
    root = tmp_path / "runs"
    write(root / "mllmu_real" / "npo_seed3.json", {"forget_accuracy": "97.5%", "retain": {"accuracy": 0.5}, "flag_forget": True})
    write(root / "unlok" / "r.json", {"results": [{"method": "npo", "fa": 0.25, "seed": 9}], "methods": {"ga": {"cnis": 0.5}, "skip": 3}})
    write(root / "mllmu_bench" / "npo.json", [{"algorithm": "npo", "forget_score": 0.125}])
    write(root / "npo_outputs.json", {"fa": 1})
    write(root / "bad.json", "{oops")
    write(root / "plain.json", {"x": 1})
    write(root / "matched" / "own.json", {"fa": 1})
    d = D.scan_result_docs(spark, [str(root), str(root / "unlok")], exclude="/matched/")
    assert d.count() == 5
    rows = G.collect_rows(d)
    got = {(r.dataset, r.method): r for r in rows.collect()}
    assert set(got) == {("mllmu_real", "npo"), ("unlok_vqa", "npo"), ("unlok_vqa", "ga"), ("mllmu_bench", "npo")}
    real = got["mllmu_real", "npo"]
    assert real.forget_accuracy == pytest.approx(0.975) and real.retain_accuracy == 0.5 and real.seed == 3
    assert got["unlok_vqa", "npo"].seed == 9 and got["unlok_vqa", "ga"].cnis == 0.5
    status = {r.source_file.split("/")[-1]: r.status for r in G.source_inventory(d, rows).collect()}
    assert status == {"npo_seed3.json": "matched", "r.json": "matched", "npo.json": "matched", "bad.json": "json_read_error", "plain.json": "unmatched"}
    assert G.unmatched(G.source_inventory(d, rows)).count() == 2
    agg = G.aggregate_results(G.dedupe_richest(rows, G.V.METRICS), G.V.METRICS)
    cover = {r.dataset: r for r in G.coverage(agg).collect()}
    assert {r.method for r in G.dataset_methods(agg).collect() if r.dataset == "unlok_vqa"} == {"ga", "npo"}
    assert cover["unlok_vqa"].n_methods == 2 and cover["mllmu_real"].verdict == "PASS" and cover["mllmu_real"].n_in_all == 1
    wide = {r.method: r for r in G.wide_table(agg, G.V.METRICS).collect()}
    assert wide["npo"]["mllmu_bench__forget_accuracy"] == 0.125 and wide["ga"]["mllmu_real__n_rows"] is None
    empty = G.coverage(agg.filter("false")).collect()
    assert {r.verdict for r in empty} == {"FAIL"}


def test_metric_choice(spark):
    leaves = spark.createDataFrame([("f", "r", "x.forget_acc", "0.1", "double"), ("f", "r", "forget_acc", "0.2", "double"), ("f", "r", "forget", "true", "boolean"), ("f", "r", "myforgetful", "0.3", "double")], "source_file string, row_id string, key string, value string, type string")
    best = {r.metric: r for r in G.extract_metrics(leaves).collect()}
    assert (best["forget_accuracy"].value, best["forget_accuracy"].score) == (0.2, 100)


def test_file_index_priority(spark):
    p = spark.createDataFrame([("/i/train/X_000000000042.jpg",), ("/i/val/000000000042.JPG",), ("/i/7.jpg",)], "path string")
    got = index_files(p, priority=F.when(F.contains(F.col("path"), F.lit("/val/")), 0).otherwise(1)).collect()
    assert [(r.file_id, r.path) for r in got] == [(42, "/i/val/000000000042.JPG")]


def test_sinks_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None), ("b", None, "x")], "run string, v double, w string")
    sinks.write_csv(df, str(tmp_path / "c"), ["v", "run", "absent"])
    text = "".join(f.read_text() for f in sorted((tmp_path / "c").glob("*.csv")))
    assert "v,run,absent" in text and "1.5,a," in text and ",b," in text
    with pytest.raises(Exception):
        sinks.write_csv(df, str(tmp_path / "c"), ["v"])
    out = str(tmp_path / "runs")
    write_run(df.filter("run = 'a'"), out)
    write_run(df.filter("run = 'b'"), out)
    done = spark.read.json(out)
    assert done.count() == 2
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "run string")
    assert [r.run for r in pending_runs(want, done, ["run"]).collect()] == ["c"]


def test_levels_opened_natively_equal_the_walk(spark):
    texts = [
        '{"a":{"b":{"c":{"d":{"e":1.5}}},"l":[1,"x",null]},"":{"":3},"n":null,"t":true,"q\'":{"x.y":"s"}}',
        '{"long":[0,1,2,3,4,5,6,7,8,9,10],"nested":[[1]],"objects":[{"a":1}],"empty":{},"none":[]}',
        '{"whole":3.0,"big":10000000000000000000000000,"exp":1e300,"neg":-2.50,"bell":"\\u0007\\"é"}',
        "{}", "[]", "[1,2]", "[{}]", "5", "null", '"null"',
    ]
    rows = spark.createDataFrame([(str(i), "$", t) for i, t in enumerate(texts)], "source_file string, row_id string, t string")
    rows = rows.withColumn("row", D.strict_json("t"))
    walked = sorted(map(str, D.flatten(rows, levels=0).collect()))
    for levels in (1, 3, 6):
        assert sorted(map(str, D.flatten(rows, levels=levels).collect())) == walked


def test_a_document_of_depth_900_is_opened(spark):
    text = "1"
    for _ in range(900):
        text = '{"k":%s}' % text
    docs = spark.createDataFrame([("a", text)], "source_file string, t string").withColumn("doc", D.strict_json("t"))
    got = D.flatten(D.candidate_rows(docs)).collect()
    assert [(r.key, r.value) for r in got] == [(".".join("k" * 900), "1")]


def test_candidate_rows_parse_a_document_once(spark):
    files = spark.createDataFrame([("a", 1, "{}")], "source_file string, size_bytes bigint, text string")
    plan = D.candidate_rows(D.parse_docs(files))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 1
