"""Running a query and its SQL twin on the same tables and comparing whole results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def compare(df, connection, sql: str) -> list[str]:
    """Differences in names, types, row count or values; empty when the results agree."""
    cursor = connection.execute(sql)
    sql_names = [d[0] for d in cursor.description]
    sql_types = {d[0]: str(d[1]) for d in cursor.description}
    want_names, want = _rows(sql_names, cursor.fetchall())
    got_names, got = _rows(df.columns, df.collect())
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    problems = [
        f"type of {name}: {kind} != {sql_types[name]}"
        for name, kind in df.dtypes
        if SAME_TYPE.get(kind) != sql_types[name]
    ]
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    elif got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        problems.append(f"{len(bad)} rows differ, first: {bad[0]}")
    return problems
