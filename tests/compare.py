"""Runs catalogue queries on Spark and DuckDB and compares the results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def normalised(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark_df, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both results agree, otherwise what differs."""
    rows = [tuple(row) for row in spark_df.collect()]
    answer = db.execute(sql)
    names = [d[0] for d in answer.description]
    kinds = {d[0]: str(d[1]).upper() for d in answer.description}
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    for name, kind in spark_df.dtypes:
        expected = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(kind)
        if expected != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    left, right = normalised(spark_df.columns, rows), normalised(names, answer.fetchall())
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    wrong = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    return f"{len(wrong)} of {len(left)} rows differ, e.g. {wrong[0]}" if wrong else None


def main() -> None:
    import __spark_entry__ as contract
    from folioscope.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    queries, oracles = contract.queries(), contract.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if chosen and name not in chosen:
            continue
        started = time.perf_counter()
        try:
            frame = run(spark, folder)
            verdict = difference(frame, db, oracles[name]) if name in oracles else f"rows only: {frame.count()}"
        except Exception as error:
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        ok = verdict is None or verdict.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name:28s} {time.perf_counter() - started:6.2f}s  {verdict or ''}", flush=True)
    print(f"{bad} bad of {len(chosen) or len(queries)}")


if __name__ == "__main__":
    main()
