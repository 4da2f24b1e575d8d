"""Run queries in Spark and their SQL in DuckDB on the same tables and compare every cell."""

import datetime as dt
import glob
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        if name in TABLES:
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return repr(value)
    return value if value is None else f"{type(value).__name__}:{value}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(cells, key=lambda r: tuple(str(c) for c in r))


def differences(spark, connection, run, sql: str, sf_dir: str) -> list[str]:
    """Empty when columns, rows and every cell agree."""
    df = run(spark, sf_dir)
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    theirs = _rows([c[0] for c in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} / {theirs[0]}"]
    if len(ours[1]) != len(theirs[1]):
        return [f"row counts {len(ours[1])} / {len(theirs[1])}"]
    found = []
    for a, b in zip(ours[1], theirs[1]):
        for name, x, y in zip(ours[0], a, b):
            if x != y:
                found.append(f"{name}: {x} / {y}   in {a[:6]}")
    return found
