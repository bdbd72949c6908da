"""Compares registered queries with their oracles: python -m checks.run SF_DIR [name ...]"""

import glob
import math
import os
import sys
import time

import duckdb

from checks.oracle import ORACLE_SQL
from checks.queries import QUERIES
from tiebreak.session import build_session


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main(sf_dir, only):
    spark = build_session("checks", os.environ.get("CHECK_MASTER", "local[8]"), **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    bad = []
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            got = df.collect()
        except Exception as e:
            print(f"FAIL {name}: {str(e)[:1500]}")
            bad.append(name)
            continue
        took = time.time() - start
        if name not in ORACLE_SQL:
            print(f"rows {name}: {len(got)} rows {took:.1f}s  {got[:1]}")
            continue
        try:
            rel = con.sql(ORACLE_SQL[name])
            want = rel.fetchall()
        except Exception as e:
            print(f"SQL  {name}: {str(e)[:600]}")
            bad.append(name)
            continue
        left, right = rows_of(df.columns, got), rows_of(rel.columns, want)
        if sorted(df.columns) != sorted(rel.columns):
            print(f"COLS {name}: {df.columns} vs {rel.columns}")
            bad.append(name)
        elif left != right:
            diff = [(a, b) for a, b in zip(left, right) if a != b]
            print(f"DIFF {name}: {len(left)} vs {len(right)} rows; first {diff[:2]}")
            bad.append(name)
        else:
            types = [f"{c}:{t}/{str(dict(zip(rel.columns, rel.types))[c])}" for c, t in df.dtypes
                     if {"string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}.get(t, t.upper())
                     != str(dict(zip(rel.columns, rel.types))[c])]
            print(f"ok   {name}: {len(left)} rows {took:.1f}s {'TYPES ' + str(types) if types else ''}")
    missing = sorted(set(ORACLE_SQL) - set(QUERIES))
    print("bad:", bad, "oracle without query:", missing)


if __name__ == "__main__":
    main(sys.argv[1], set(sys.argv[2:]))
