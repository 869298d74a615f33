"""Runs queries at a size beside their DuckDB SQL: python tests/oracle.py DIR [NAME...]"""

import datetime
import glob
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def oracle_rows(sf_dir, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    found = con.sql(sql)
    return rows_of(found.columns, found.fetchall())


def spark_rows(spark, sf_dir, query):
    df = query(spark, sf_dir)
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


if __name__ == "__main__":
    import time

    import __spark_entry__ as entry
    from quern.session import local_session

    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    sql = entry.oracle_sql()
    for name, f in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            got = spark_rows(spark, sys.argv[1], f)
            want = oracle_rows(sys.argv[1], sql[name]) if name in sql else None
            same = want is None or got == want
            print(f"{name}: {'ok' if want and same else 'rows only' if want is None else 'DIFFERS'} {len(got[1])} rows, {time.time() - t:.1f} s", flush=True)
            if not same:
                print("   spark ", got[0], [r for r in got[1] if r not in want[1][:200000]][:3], "\n   duckdb", want[0], [r for r in want[1] if r not in got[1][:200000]][:3], len(want[1]))
        except Exception as e:
            print(f"{name}: FAILED {str(e)[:400]}", flush=True)
