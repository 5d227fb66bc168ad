"""Run every registered query next to its DuckDB SQL and compare (like the driver does).

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


EXACT = "--exact" in sys.argv  # compare floats bit for bit instead of to 6 decimals


def norm(v):
    if isinstance(v, float):
        return v if EXACT else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v.normalize()) if v == v else "nan")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf, names=None):
    import __spark_entry__ as e

    qs, sql = e.queries(), e.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    failures = []
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(ex).__name__}: {str(ex)[:400]}")
            failures.append(name)
            continue
        took = time.time() - t0
        if name not in sql:
            print(f"ROWS {name}: {len(s_rows)} rows, no oracle ({took:.1f}s)")
            continue
        rel = con.sql(sql[name])
        d_cols, d_rows = rel.columns, rel.fetchall()
        problems = []
        if sorted(s_cols) != sorted(d_cols):
            problems.append(f"columns {sorted(s_cols)} vs {sorted(d_cols)}")
        if len(s_rows) != len(d_rows):
            problems.append(f"rows {len(s_rows)} vs {len(d_rows)}")
        if not problems:
            a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                problems.append(f"values differ, e.g. {diff}")
        status = "OK  " if not problems else "FAIL"
        print(f"{status} {name}: {len(s_rows)} rows ({took:.1f}s) {'; '.join(problems)[:600]}")
        if problems:
            failures.append(name)
    return failures


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if a not in ("--plain", "--exact")]
    sf = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or None
    if "--plain" in sys.argv:  # a bare session, as an outside driver would build it
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    else:
        from sluice.session import local_session

        spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    bad = compare(spark, sf, names)
    print("FAILED:", bad if bad else "none")
    sys.exit(1 if bad else 0)
