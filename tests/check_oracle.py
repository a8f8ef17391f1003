"""Run queries beside their SQL on one data directory and compare whole results.

    python tests/check_oracle.py [data directory] [name prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6f}"
        if isinstance(v, int):
            return str(v)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(path):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{path}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, name, query, sql, path):
    df = query(spark, path)
    t = time.time()
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return ("rows", len(got), took, "")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return ("FAIL", len(got), took, f"columns {sorted(df.columns)} / {sorted(columns)}")
    a, b = canonical(got, df.columns), canonical(want, columns)
    if a == b:
        return ("ok", len(got), took, "")
    sa, sb = set(a), set(b)
    only = [x for x in a if x not in sb][:3], [x for x in b if x not in sa][:3]
    return ("FAIL", len(got), took, f"{len(a)} / {len(b)} rows; only Spark {only[0]}; only SQL {only[1]}")


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


if __name__ == "__main__":
    from remnant.plans import registry

    path = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), duck(path)
    oracle = registry.oracle_sql()
    bad = 0
    for name, query in registry.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        t = time.time()
        try:
            status = compare(spark, con, name, query, oracle.get(name), path)
        except Exception as e:  # report and go on
            status = ("ERROR", 0, 0.0, str(e).split(chr(10))[0][:500])
        bad += status[0] in ("FAIL", "ERROR")
        print(f"{status[0]:5} {name:40} rows={status[1]} run={status[2]:.1f}s all={time.time() - t:.1f}s {status[3]}", flush=True)
    print("bad:", bad)
