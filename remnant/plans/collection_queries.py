"""Queries that read and collect result documents derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from remnant.functions import fixed_values as V
from remnant.operators import collection as G
from remnant.operators import quality as Q
from remnant.plans import sql as S
from remnant.plans.registry import register
from remnant.plans.sql import r, with_
from remnant.plans.views import Tables
from remnant.sources import documents as D
from remnant.sources import items as I
from remnant.sources import sinks
from remnant.sources.storage import new_dir

METRICS3 = ["forget_accuracy", "retain_accuracy", "cnis"]


# -- documents: one per order ----------------------------------------------------------
def docs(t: Tables):
    """Each order as a nested result document; one in eleven is unreadable."""
    k, x = F.col("o_orderkey"), F.col("o_totalprice")
    pct = F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%"))
    body = F.struct(
        F.when(k % 2 == 0, "MLLMU-Real").otherwise("unlok").alias("dataset"),
        F.struct(k.alias("seed"), F.lit(True).alias("mia")).alias("config"),
        F.array(
            F.struct(F.lit("NPO").alias("method"), (x / 1000000).alias("forget_acc"), pct.alias("retain_acc")),
            F.struct(F.lit("grad-diff").alias("method"), F.lit(0.25).alias("forget_acc"), F.lit("n/a").alias("retain_acc")),
        ).alias("results"),
        F.struct(F.struct(F.lit(0.5).alias("lb_cka"), F.array(F.lit(1), F.lit(2)).alias("layers")).alias("ga")).alias("methods"),
        F.array(*[F.lit(i) for i in range(12)]).alias("long_list"),
    )
    text = F.when(k % 11 == 0, F.concat(F.lit("{broken "), k.cast("string"))).otherwise(F.to_json(body))
    files = t.table("orders").select(
        F.concat(F.when(k % 2 == 0, "/runs/mllmu-real/").otherwise("/runs/unlok/"), k.cast("string"), F.lit(".json")).alias("source_file"),
        F.length(text).cast("bigint").alias("size_bytes"), text.alias("text"),
    )
    return D.parse_docs(files)


OK = """docs AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN '/runs/mllmu-real/' ELSE '/runs/unlok/' END || CAST(o_orderkey AS VARCHAR) || '.json' AS source_file, o_orderkey AS k, o_orderkey % 11 <> 0 AS ok, o_totalprice / 1000000 AS fa,
  CAST(o_custkey % 100 AS VARCHAR) || '%' AS pct, o_custkey % 100 AS pn, CASE WHEN o_orderkey % 2 = 0 THEN 'MLLMU-Real' ELSE 'unlok' END AS ds FROM orders)"""
CANDIDATES = OK + """, cand AS (SELECT d.*, c.* FROM docs d, (VALUES ('$', NULL), ('results[0]', NULL), ('results[1]', NULL), ('methods.ga', 'ga')) c(row_id, container_key) WHERE d.ok)"""


@register("s06_candidate_rows", with_(CANDIDATES) + "SELECT source_file, row_id, container_key FROM cand")
def s06(t: Tables):
    return D.candidate_rows(docs(t)).select("source_file", "row_id", "container_key")


LEAVES = CANDIDATES + """, leaves AS (SELECT source_file, c.row_id, l.key, CASE l.v WHEN 'ds' THEN ds WHEN 'k' THEN CAST(k AS VARCHAR) WHEN 'pct' THEN pct ELSE l.v END AS value, l.type FROM cand c JOIN (VALUES
 ('$', 'dataset', 'ds', 'string'), ('$', 'config.seed', 'k', 'bigint'), ('$', 'config.mia', 'true', 'boolean'), ('$', 'methods.ga.lb_cka', '0.5', 'num'), ('$', 'methods.ga.layers', '[1,2]', 'array'),
 ('results[0]', 'method', 'NPO', 'string'), ('results[0]', 'retain_acc', 'pct', 'string'), ('results[1]', 'method', 'grad-diff', 'string'), ('results[1]', 'forget_acc', '0.25', 'num'), ('results[1]', 'retain_acc', 'n/a', 'string'),
 ('methods.ga', 'lb_cka', '0.5', 'num'), ('methods.ga', 'layers', '[1,2]', 'array')) l(row_id, key, v, type) ON l.row_id = c.row_id)"""


@register("s07_flatten", with_(LEAVES) + "SELECT source_file, row_id, key, value FROM leaves UNION ALL SELECT source_file, 'results[0]', 'forget_acc', CAST(CAST(fa AS DECIMAL(18,9)) AS VARCHAR) FROM docs WHERE ok")
def s07(t: Tables):
    f = D.flatten(D.candidate_rows(docs(t)))
    # The price has eight places and is printed with nine: engines print doubles differently.
    price = (F.col("row_id") == "results[0]") & (F.col("key") == "forget_acc")
    return f.select("source_file", "row_id", "key", F.when(price, F.col("value").cast("decimal(18,9)").cast("string")).otherwise(F.col("value")).alias("value"))


@register("g01_extract_metrics", with_(OK) + f"""SELECT source_file, row_id, metric, {r('value')} AS value, matched_key, score FROM (
SELECT source_file, 'results[0]' AS row_id, 'forget_accuracy' AS metric, fa AS value, 'forget_acc' AS matched_key, 100 AS score FROM docs WHERE ok
UNION ALL SELECT source_file, 'results[0]', 'retain_accuracy', pn / 100.0, 'retain_acc', 100 FROM docs WHERE ok
UNION ALL SELECT source_file, 'results[0]', 'overall_accuracy', CASE WHEN true THEN fa END, 'forget_acc', 90 FROM docs WHERE ok
UNION ALL SELECT source_file, 'results[1]', 'forget_accuracy', 0.25, 'forget_acc', 100 FROM docs WHERE ok
UNION ALL SELECT source_file, 'results[1]', 'overall_accuracy', 0.25, 'forget_acc', 90 FROM docs WHERE ok
UNION ALL SELECT source_file, 'methods.ga', 'cka_language', 0.5, 'lb_cka', 100 FROM docs WHERE ok
UNION ALL SELECT source_file, '$', 'cka_language', 0.5, 'methods_ga_lb_cka', 90 FROM docs WHERE ok)""")
def g01(t: Tables):
    return G.extract_metrics(D.flatten(D.candidate_rows(docs(t))))


@register("s06_collect_rows", with_(OK) + f"""SELECT CASE WHEN k % 2 = 0 THEN 'mllmu_real' ELSE 'unlok_vqa' END AS dataset, c.method, CAST(NULL AS BIGINT) AS seed, source_file, c.row_id,
CASE c.method WHEN 'npo' THEN {r('fa')} WHEN 'graddiff' THEN 0.25::DOUBLE END AS forget_accuracy, CASE c.method WHEN 'npo' THEN {r('pn / 100.0')} END AS retain_accuracy, CASE c.method WHEN 'ga' THEN 0.5::DOUBLE END AS cka_language
FROM docs, (VALUES ('npo', 'results[0]'), ('graddiff', 'results[1]'), ('ga', 'methods.ga')) c(method, row_id) WHERE ok""")
def collected(t: Tables):
    rows = G.collect_rows(docs(t))
    return rows.select("dataset", "method", "seed", "source_file", "row_id", "forget_accuracy", "retain_accuracy", "cka_language")


@register("g06_source_inventory", with_(OK) + "SELECT source_file, CASE WHEN ok THEN 'matched' ELSE 'json_read_error' END AS status, CASE WHEN ok THEN 3 ELSE 0 END AS metric_count FROM docs")
def g06(t: Tables):
    d = docs(t)
    return G.source_inventory(d, G.collect_rows(d)).select("source_file", "status", "metric_count")


@register("s04_unwrap_records", """SELECT '/runs/' || CAST(o_orderkey AS VARCHAR) AS source_file, i AS n, CASE WHEN o_orderkey % 3 = 2 THEN 'key' || CAST(i AS VARCHAR) END AS source_key
FROM orders, (SELECT unnest([1, 2]) AS i)""")
def s04(t: Tables):
    k = F.col("o_orderkey")
    one, two = F.struct(F.lit(1).alias("n")), F.struct(F.lit(2).alias("n"))
    text = (
        F.when(k % 3 == 0, F.to_json(F.array(one, two)))
        .when(k % 3 == 1, F.to_json(F.struct(F.array(one, two).alias("records"), k.alias("id"))))
        .otherwise(F.to_json(F.struct(one.alias("key1"), two.alias("key2"), k.alias("id"))))
    )
    d = t.table("orders").select(
        F.concat(F.lit("/runs/"), k.cast("string")).alias("source_file"), F.try_parse_json(text).alias("doc")
    )
    return D.unwrap_records(d).select(
        "source_file", F.try_variant_get("record", "$.n", "bigint").alias("n"), "source_key"
    )


def probe_docs(t: Tables):
    """Probe records nested under entity and relation; every seventh has no label."""
    record = F.struct(
        F.col("source").alias("name"), F.col("lang").alias("predicate"),
        F.when(F.col("doc_id") % 7 != 0, F.col("doc_id").cast("string")).alias("answer"),
        F.col("text").alias("output"), F.array(F.col("lang"), F.col("source")).alias("aliases"),
    )
    text = F.to_json(F.struct(F.struct(F.array(record).alias("probes")).alias("by_relation")))
    return t.documents().select(F.col("doc_id").cast("string").alias("source_file"), F.try_parse_json(text).alias("doc"))


@register("s08_find_records", "SELECT CAST(doc_id AS VARCHAR) AS source_file, 'by_relation.probes[0]' AS json_path, source AS entity, lang AS relation, CAST(doc_id AS VARCHAR) AS label, md5(text) AS response, '[\"' || lang || '\",\"' || source || '\"]' AS aliases FROM documents WHERE doc_id % 7 <> 0")
def s08(t: Tables):
    found = D.find_records(probe_docs(t))
    return found.select("source_file", "json_path", "entity", "relation", "label", F.md5("response").alias("response"), "aliases")


@register("s10_read_entity_values", f"""SELECT CAST(vec_id AS VARCHAR) AS source_file, 'e' || CAST(label AS VARCHAR) || '_' || CAST(i AS VARCHAR) AS entity,
{r('CAST(embedding[i + 1] AS DOUBLE)')} AS ve, {r('CAST(embedding[(i + 1) % n + 1] AS DOUBLE)')} AS br, CASE WHEN vec_id % 4 <> 0 THEN {r('CAST(embedding[(i + 2) % n + 1] AS DOUBLE)')} END AS lb
FROM (SELECT *, len(embedding) AS n, unnest(range(len(embedding))) AS i FROM embeddings)""")
def s10(t: Tables):
    """One entity for each unit: its value and those of the two units after it, in a circle."""
    n = F.size("embedding")
    even = F.col("vec_id") % 2 == 0
    odd_fourth = F.col("vec_id") % 4 != 0

    def entry(i):
        ve, br, lb = (F.get("embedding", (i + k) % n).cast("double") for k in range(3))
        return F.struct(
            F.concat(F.lit("e"), F.col("label").cast("string"), F.lit("_"), i.cast("string")).alias("key"),
            F.struct(
                F.when(even, ve).alias("ve"), F.when(~even, ve).alias("ve_mean"),
                F.when(even, br).alias("bridge_mean"), F.when(~even, br).alias("br"),
                F.when(odd_fourth, lb).alias("lb_mean"),
            ).alias("value"),
        )

    units = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    text = F.to_json(F.struct(F.map_from_entries(F.transform(units, entry)).alias("per_entity")))
    d = t.table("embeddings").select(F.col("vec_id").cast("string").alias("source_file"), F.try_parse_json(text).alias("doc"))
    return D.read_entity_values(d)


# -- files derived from the tables, written once into the shared folder ------------------
@register("s01_read_items_flat", with_(S.QA_LISTS) + """SELECT CASE WHEN turn % 4 = 0 THEN 'e' || CAST(entity AS VARCHAR) WHEN turn % 4 = 2 THEN 'n' || CAST(entity AS VARCHAR) ELSE 'unknown' END AS entity,
 md5(question) AS question, CASE WHEN entity % 2 = 0 THEN md5(answer) ELSE md5(answer || '!') END AS answer FROM qa_lists""")
def s01(t: Tables):
    entity = F.col("entity").cast("string")
    item = F.struct(
        F.lit("a.jpg").alias("image"), F.col("question"),
        F.when(F.col("entity") % 2 == 0, F.col("answer")).alias("answer"),
        F.concat("answer", F.lit("!")).alias("gt"),
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("e"), entity)).alias("entity"),
        F.when(F.col("turn") % 4 == 2, F.concat(F.lit("n"), entity)).alias("name"),
    )
    path = new_dir(t.spark, "items")
    # One JSON array per line, so that large files stay splittable.
    t.qa_lists().select(F.to_json(F.array(item)).alias("value")).write.text(path)
    rows = I.read_items(t.spark, path, "d", "forget", multi_line=False, file_glob="*.txt")
    return rows.select("entity", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@register("s02_read_items_folders", "SELECT source AS entity, md5(text) AS question, lang AS answer FROM documents WHERE source <> 'src3'")
def s02(t: Tables):
    """One folder per source; folder src3 gets no image file and is skipped."""
    path = new_dir(t.spark, "folders")
    d = t.documents()
    item = F.to_json(F.struct(F.col("text").alias("question"), F.col("lang").alias("gt")))
    # One file per folder, as the layout prescribes; lines keep it splittable for readers.
    d.select("source", item.alias("value")).repartition("source").write.partitionBy("source").text(path)
    d.filter(F.col("source") != "src3").groupBy("source").agg(F.min("doc_id").alias("image")).repartition(
        "source"
    ).write.mode("append").partitionBy("source").json(path)
    rows = I.read_items(
        t.spark, path, "d", "retain", "folders", multi_line=False, file_glob="*.txt", image_glob="*.json",
        folder_regex=r"/source=([^/]+)/[^/]+$",
    )
    return rows.select("entity", F.md5("question").alias("question"), "answer")


@register("s03_read_json_lines", """SELECT CAST(count(*) FILTER (WHERE doc_id % 9 <> 0) AS BIGINT) AS n_docs, CAST(count(*) FILTER (WHERE doc_id % 9 = 0) AS BIGINT) AS n_errors,
CAST(sum(CASE WHEN doc_id % 9 <> 0 THEN doc_id END) AS BIGINT) AS id_sum FROM documents""")
def s03(t: Tables):
    path = new_dir(t.spark, "lines")
    bad = F.concat(F.lit("{bad "), F.col("doc_id").cast("string"))
    line = F.when(F.col("doc_id") % 9 == 0, bad).otherwise(F.to_json(F.struct("doc_id", "text")))
    t.documents().select(line.alias("value")).write.text(path)
    rows = D.read_jsonl(t.spark, path)
    return rows.agg(
        F.count("doc").alias("n_docs"), F.count("error").alias("n_errors"),
        F.sum(F.try_variant_get("doc", "$.doc_id", "bigint")).alias("id_sum"),
    )


@register("s03_prediction_documents", """SELECT o_orderkey AS source_file, o_orderkey AS first_id, 2 AS n FROM orders WHERE o_orderkey % 7 <> 6""")
def s03_predictions(t: Tables):
    """A bare list, a list under each known key, and an object that holds no records."""
    k = F.col("o_orderkey")
    rows = F.concat(F.lit("[{\"id\":"), k.cast("string"), F.lit("},{\"id\":"), (k + 1).cast("string"), F.lit("},7]"))
    text = F.when(k % 7 == 6, F.lit('{"other":1}')).otherwise(rows)
    for i, name in enumerate(V.PREDICTION_KEYS):
        text = F.when(k % 7 == i, F.concat(F.lit(f'{{"n":2,"{name}":'), rows, F.lit("}"))).otherwise(text)
    files = t.table("orders").select(k.alias("source_file"), F.length(text).cast("bigint").alias("size_bytes"), text.alias("text"))
    found = D.read_predictions(D.parse_docs(files))
    return found.groupBy("source_file").agg(
        F.min(F.try_variant_get("record", "$.id", "bigint")).alias("first_id"), F.count(F.lit(1)).alias("n")
    )


@register("s03_json_or_lines", """SELECT CAST(count(*) FILTER (WHERE doc_id % 9 <> 0 OR doc_id % 2 = 0) AS BIGINT) AS n_docs, CAST(count(*) FILTER (WHERE doc_id % 9 = 0 AND doc_id % 2 = 1) AS BIGINT) AS n_errors,
CAST(sum(CASE WHEN doc_id % 9 <> 0 OR doc_id % 2 = 0 THEN doc_id END) AS BIGINT) AS id_sum FROM documents""")
def s03_mixed(t: Tables):
    """Files of one JSON list, and files of lines of which some are broken."""
    path = new_dir(t.spark, "mixed")
    k, line = F.col("doc_id"), F.to_json(F.struct("doc_id"))
    body = F.concat(F.lit("["), F.array_join(F.collect_list(line), ",\n"), F.lit("]"))
    docs = t.documents()
    whole = docs.filter(k % 2 == 0).groupBy(F.floor(k / 64)).agg(body.alias("value")).select("value")
    whole.write.option("maxRecordsPerFile", 1).text(f"{path}/whole")
    broken = F.when(k % 9 == 0, F.lit("{bad")).otherwise(line)
    docs.filter(k % 2 == 1).select(broken.alias("value")).write.text(f"{path}/lines")
    rows = D.read_json_or_jsonl(t.spark, [f"{path}/whole", f"{path}/lines"])
    ids = rows.select("error", F.explode_outer(F.coalesce(
        F.try_variant_get("doc", "$", "array<struct<doc_id:bigint>>"), F.array(F.try_variant_get("doc", "$", "struct<doc_id:bigint>"))
    )).alias("e"))
    return ids.agg(F.count("e.doc_id").alias("n_docs"), F.count("error").alias("n_errors"), F.sum("e.doc_id").alias("id_sum"))


@register("s05_scan_result_docs", "SELECT CAST(count(DISTINCT o_custkey % 40) AS BIGINT) AS n_files, 0 AS n_errors FROM orders WHERE o_custkey % 40 <> 7")
def s05(t: Tables):
    """Result files of 40 folders, one of them excluded as the collector's own output."""
    path = new_dir(t.spark, "results")
    summary = t.table("orders").groupBy((F.col("o_custkey") % 40).alias("folder")).agg(
        F.avg("o_totalprice").alias("forget_acc"), F.count(F.lit(1)).alias("n")
    )
    summary.repartition("folder").write.partitionBy("folder").json(path)
    found = D.scan_result_docs(t.spark, [path, f"{path}/folder=3"], exclude="/folder=7/")
    return found.agg(F.countDistinct(F.regexp_extract("source_file", "folder=([0-9]+)", 1)).alias("n_files"), F.count("error").alias("n_errors"))


@register("s12_csv_sink", with_(S.RESULTS) + f"SELECT dataset, method, n_rows, {r('f')} AS forget_accuracy FROM (SELECT dataset, method, count(*) AS n_rows, avg(forget_accuracy) AS f FROM results_long GROUP BY 1, 2)")
def s12(t: Tables):
    path = new_dir(t.spark, "csv")
    table = G.aggregate_results(t.results_long(), METRICS3)
    sinks.write_csv(table, path, ["dataset", "method", "n_rows", "forget_accuracy"])
    schema = "dataset string, method string, n_rows bigint, forget_accuracy double"
    return t.spark.read.schema(schema).option("header", "true").csv(path)


@register("s13_json_sink", "SELECT o_orderstatus AS run, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def s13(t: Tables):
    from remnant.streaming.incremental import write_run

    path = new_dir(t.spark, "runs")
    write_run(t.table("orders").select(F.col("o_orderstatus").alias("run"), "o_orderkey"), path)
    return t.spark.read.schema("o_orderkey bigint, run string").json(path).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@register("s13_replaced_runs", f"""SELECT o_orderstatus AS run, CASE WHEN o_orderstatus = 'F' THEN '2' ELSE '1' END AS version, count(*) AS n_rows, count(*) AS n,
{r("sum(CASE WHEN o_orderstatus = 'F' THEN 2 * CAST(o_totalprice AS DOUBLE) ELSE CAST(o_totalprice AS DOUBLE) END)")} AS total FROM orders GROUP BY 1""")
def s13_replaced(t: Tables):
    """All runs are written, then one again under a newer scorer: readers see its new rows alone."""
    from remnant.streaming.results import latest_runs, publish_runs, read_runs

    path = new_dir(t.spark, "results")
    price = F.col("o_totalprice").cast("double")
    rows = t.table("orders").select(F.col("o_orderstatus").alias("run"), "o_orderkey", price.alias("score"))
    publish_runs(rows, path, "1")
    publish_runs(rows.filter("run = 'F'").withColumn("score", F.col("score") * 2), path, "2")
    found = read_runs(t.spark, path, rows.schema).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))
    return latest_runs(t.spark, path).join(found, "run").select("run", "version", "n_rows", "n", "total")


# -- aggregated results -----------------------------------------------------------------
_R = with_(S.RESULTS)
DEDUP = """best AS (SELECT * FROM results_long QUALIFY row_number() OVER (PARTITION BY dataset, method, seed, source_file
  ORDER BY (CASE WHEN retain_accuracy IS NULL THEN 0 ELSE 1 END) + (CASE WHEN cnis IS NULL THEN 0 ELSE 1 END) DESC, row_id) = 1)"""
AGG = f"""agg AS (SELECT dataset, method, count(*) AS n_rows, avg(forget_accuracy) AS fa, avg(retain_accuracy) AS ra, avg(cnis) AS cn, count(DISTINCT seed) AS n_seeds,
  count(DISTINCT source_file) AS n_sources FROM best GROUP BY 1, 2)"""


def best(t: Tables):
    return G.dedupe_richest(t.results_long(), METRICS3)


@register("g02_dedupe_richest", with_(S.RESULTS, DEDUP) + f"SELECT dataset, method, seed, source_file, row_id, {r('forget_accuracy')} AS forget_accuracy, {r('retain_accuracy')} AS retain_accuracy, {r('cnis')} AS cnis FROM best")
def g02(t: Tables):
    return best(t)


@register("g03_aggregate_results", with_(S.RESULTS, DEDUP, AGG) + f"SELECT dataset, method, n_rows, {r('fa')} AS forget_accuracy, {r('ra')} AS retain_accuracy, {r('cn')} AS cnis, n_seeds, n_sources AS n_source_files FROM agg")
def g03(t: Tables):
    return G.aggregate_results(best(t), METRICS3)


@register("g03_result_sources", with_(S.RESULTS, DEDUP) + "SELECT DISTINCT dataset, method, seed, source_file FROM best")
def g03_sources(t: Tables):
    return G.result_sources(best(t))


_WIDE = ", ".join(
    f"{r(f'max({c}) FILTER (WHERE dataset = {chr(39)}{d}{chr(39)})')} AS {d}__{n}" if c in ("fa", "ra", "cn") else f"max({c}) FILTER (WHERE dataset = '{d}') AS {d}__{n}"
    for d in V.DATASET_ALIASES for c, n in (("fa", "forget_accuracy"), ("ra", "retain_accuracy"), ("cn", "cnis"), ("n_rows", "n_rows"), ("n_seeds", "n_seeds"))
)


@register("g04_wide_table", with_(S.RESULTS, DEDUP, AGG) + f"SELECT method, {_WIDE} FROM agg GROUP BY method")
def g04(t: Tables):
    return G.wide_table(G.aggregate_results(best(t), METRICS3), METRICS3)


@register("g05_coverage", with_(S.RESULTS, DEDUP, AGG) + """SELECT dataset, count(*) AS n_methods,
(SELECT count(*) FROM (SELECT method FROM agg GROUP BY method HAVING count(*) = 3)) AS n_in_all, CASE WHEN (SELECT count(DISTINCT dataset) FROM agg) = 0 THEN 'FAIL'
 WHEN (SELECT count(DISTINCT dataset) FROM agg) < 2 OR (SELECT count(*) FROM (SELECT method FROM agg GROUP BY method HAVING count(*) = 3)) = 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM agg GROUP BY dataset""")
def g05(t: Tables):
    return G.coverage(G.aggregate_results(best(t), METRICS3))


@register("g05_dataset_methods", with_(S.RESULTS, DEDUP) + "SELECT DISTINCT dataset, method FROM best")
def g05_methods(t: Tables):
    return G.dataset_methods(G.aggregate_results(best(t), METRICS3))


@register("g13_top_sources", _R + "SELECT source_file, count(*) AS n FROM results_long GROUP BY 1 ORDER BY n DESC, source_file LIMIT 20")
def g13(t: Tables):
    return Q.top_sources(t.results_long(), 20)
