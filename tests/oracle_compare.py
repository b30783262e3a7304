"""Runs registered queries beside their oracles and compares the results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in sorted(value.items()))
    return value


def rows_of(columns, raw):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in raw), key=repr)


def compare(spark, connection, key, query, sql, folder):
    df = query(spark, folder)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    right = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(set(df.columns) ^ set(names))}"
    if len(left) != len(right):
        return f"row count {len(left)} != {len(right)}"
    columns = sorted(names)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        a, b = bad[0]
        return f"{len(bad)} rows differ, first: " + "; ".join(f"{c}: {x!r} != {y!r}" for c, x, y in zip(columns, a, b) if x != y)[:600]
    return None


def main(argv):
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry_module
    from rankloom.session import build_session

    folder = argv[0]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    failed = 0
    for key in argv[1:] or queries:
        matching = [k for k in queries if k == key or (key.endswith("*") and k.startswith(key[:-1]))]
        for name in matching:
            started = time.time()
            try:
                if name in oracles:
                    problem = compare(spark, connection, name, queries[name], oracles[name], folder)
                else:
                    problem = None
                    print("   rows only:", len(queries[name](spark, folder).collect()))
            except Exception as error:  # report and go on with the next query
                problem = f"{type(error).__name__}: {str(error)[:900]}"
            failed += problem is not None
            print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
