"""Run each query next to its SQL and compare rows; used by the tests and as a script."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value: object) -> object:
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, folder: str, name: str, query, sql: str) -> tuple[bool, str]:
    started = time.time()
    frame = query(spark, folder)
    ours = _rows(frame.columns, frame.collect())
    seconds = time.time() - started
    result = duck(folder).execute(sql)
    names = [column[0] for column in result.description]
    theirs = _rows(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} != {sorted(names)}"
    if ours != theirs:
        first = next(((a, b) for a, b in zip(ours, theirs) if a != b), None)
        return False, f"{len(ours)} vs {len(theirs)} rows; first difference {first}"
    return True, f"{len(ours)} rows, {seconds:.2f} s"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as contract
    from tenderloom.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    session = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                            spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    sqls = contract.oracle_sql()
    for name, query in contract.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            good, detail = compare(session, folder, name, query, sqls[name])
        except Exception as problem:  # noqa: BLE001
            good, detail = False, f"{type(problem).__name__}: {str(problem)[:1500]}"
        print("ok  " if good else "FAIL", name, detail, flush=True)
