"""Same rows from Spark and from DuckDB, whatever their order."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def duck_rows(connection, sql: str) -> tuple[list[str], list[str]]:
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    return names, _texts(names, result.fetchall())


def spark_rows(df) -> tuple[list[str], list[str]]:
    return df.columns, _texts(df.columns, [tuple(r) for r in df.collect()])


def _texts(names: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(repr(row[i]) for i in order) for row in rows)
