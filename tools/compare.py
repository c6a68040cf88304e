"""Run registered queries against their oracles: python tools/compare.py [folder] [name ...]"""
import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from payproof.plans import bridge, catalogue  # noqa: E402


def session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("compare").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (datetime, date)):
        return str(v)[:19]
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def main() -> None:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = args or list(catalogue.QUERIES)
    spark = session()
    con = duckdb.connect()
    for t in bridge.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = catalogue.QUERIES[name](spark, folder)
            got = rows_of(df.columns, df.collect())
        except Exception as e:      # noqa: BLE001 - report and go on
            print(f"{name}: SPARK {str(e)[:1500]}")
            bad += 1
            continue
        took = time.time() - t0
        sql = catalogue.ORACLES.get(name)
        if sql is None:
            print(f"{name}: rows={len(got)} no oracle {took:.1f}s {got[:1]}")
            continue
        try:
            t0 = time.time()
            rel = con.sql(sql)
            cols = rel.columns
            want = rows_of(cols, rel.fetchall())
        except Exception as e:      # noqa: BLE001
            print(f"{name}: DUCK {str(e)[:1500]}")
            bad += 1
            continue
        ok = sorted(df.columns) == sorted(cols) and got == want
        types = [(a.name, a.dataType.simpleString()) for a in df.schema] if not ok else ""
        print(f"{name}: {'ok' if ok else 'DIFF'} rows={len(got)}/{len(want)} {took:.1f}s duck {time.time() - t0:.1f}s {types}")
        if not ok:
            bad += 1
            g, w = set(got), set(want)
            print("   spark only", len(g - w), sorted(g - w)[:3])
            print("   duck only ", len(w - g), sorted(w - g)[:3])
    print("problems:", bad)


if __name__ == "__main__":
    main()
