"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion into a no-op sink, so that results are computed in full but
not moved through the driver.  The session is warmed up once on the smallest table.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a02_behaviour_table", "a03_attack_rates", "a05_entity_recovery", "a06_flip_counts",
    "a09_prompt_occurrence", "a14_audit_taxonomy", "b02_example_bootstrap",
    "b03_cluster_bootstrap", "b04_entity_value_bootstrap", "c02_linear_cka_debiased",
    "c03_rbf_cka", "c05_rsa", "c08_layer_pooling", "c13_entity_residual", "c15_influence_loeo",
    "g03_aggregate_results", "j01_align_runs", "j07_response_overlap", "j11_answers_in_corpus",
    "k02_spearman", "l03_likelihood_summary", "n02_cnis", "n04_shuffled_control_leakage",
    "p04_spread_k_per_entity", "r01_entity_or_answer", "r03_answer_or_alias_normalized",
    "s06_collect_rows", "t02_norm_compact",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from remnant.plans import registry

    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = registry.queries()
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(queries)
    spark.read.parquet(f"{path}/nation.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(path.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
