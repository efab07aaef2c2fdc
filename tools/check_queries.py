"""Run registered queries against their SQL on DuckDB: `python tools/check_queries.py [sf_dir] [name or module prefix ...]`."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    """Comparable form of a cell: lists and structs as nested tuples, exact numbers."""
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in value.asDict().items())
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if isinstance(value, np.generic):
        return value.item()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark_df, con, sql):
    """None when equal, else what differs."""
    columns, rows = spark_df.columns, spark_df.collect()
    if sql is None:
        return f"rows only: {len(rows)}"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(columns):
        return f"DIFF columns {sorted(columns)} / {sorted(names)}"
    got, want = rows_of(columns, rows), rows_of(names, result.fetchall())
    if len(got) != len(want):
        return f"DIFF rows {len(got)} / {len(want)}"
    if not got:
        return "DIFF empty on both sides"
    for a, b in zip(got, want):
        if repr(a) != repr(b):
            return f"DIFF\n   spark {str(a)[:600]}\n   sql   {str(b)[:600]}"
    return None


def main():
    from termweave import build_session
    from termweave.catalog import ORACLES, QUERIES

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session("check", master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, function in QUERIES.items():
        module = function.__module__.rsplit(".", 1)[-1]
        if args and not any(name == a or module == a for a in args):
            continue
        start = time.time()
        try:
            problem = compare(function(spark, sf_dir), con, ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            problem = "ERROR " + str(error)[:1500]
        failed += bool(problem) and not problem.startswith("rows only")
        print(f"{name:28s} {time.time() - start:6.1f}s  {problem or 'ok'}", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
