"""Run registered queries and their SQL checks side by side.

    python tools/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import tempfile
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kerbline.plans.catalog import CATALOG  # noqa: E402
from kerbline.plans.registry import Tables  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cores: str = "8", partitions: str = "8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("kerbline")
             .config("spark.sql.shuffle.partitions", partitions)
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    """One spelling per value, whatever engine it came from."""
    if v is None:
        return None
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0 if v else 0.0)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return sorted((k, plain(x)) for k, x in v.asDict().items())
    if isinstance(v, dict):
        return sorted((k, plain(x)) for k, x in v.items())
    return str(v)


def rows_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, folder, name):
    """Return (status, rows, seconds, detail)."""
    fn, sql = CATALOG[name]
    start = time.time()
    df = fn(Tables(spark, folder))
    got = df.collect()
    took = time.time() - start
    if not sql:
        return ("rows", len(got), took, "") if got else ("EMPTY", 0, took, "")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        ca, cb = Counter(map(repr, a)), Counter(map(repr, b))
        only, miss = list((ca - cb))[:3], list((cb - ca))[:3]
        return "DIFF", len(got), took, f"{len(a)} vs {len(b)} rows\n   cols {sorted(names)}\n   spark {only}\n   sql   {miss}"
    return ("ok" if got else "EMPTY"), len(got), took, ""


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--prefix", default=None)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark, con = session(), database(folder)
    bad = 0
    names = args.names or list(CATALOG)
    if args.prefix:
        names = [n for n in CATALOG if CATALOG[n][0].__module__.endswith(args.prefix)]
    for name in names:
        try:
            status, n, took, detail = compare(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            status, n, took, detail = "ERROR", 0, 0.0, str(e)[:1500]
        bad += status not in ("ok", "rows")
        print(f"{status:8s}{name:40s}{n:8d} rows {took:7.2f}s {detail}", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
