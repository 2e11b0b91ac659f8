"""Compare a catalog query with its DuckDB counterpart, values and types."""

from __future__ import annotations

import math
import os

import duckdb

TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        table = name.removesuffix(".parquet")
        db.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{name}')")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, db, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    relation = db.sql(sql)
    problems = []
    ours = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    theirs = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    if ours != theirs:
        problems.append(f"schema: {sorted(set(ours.items()) ^ set(theirs.items()))}")
    left = rows(df.columns, [tuple(r) for r in df.collect()])
    right = rows(relation.columns, relation.fetchall())
    if len(left) != len(right):
        problems.append(f"rows: {len(left)} vs {len(right)}")
    if left != right:
        odd = [(a, b) for a, b in zip(left, right) if a != b][:2]
        problems.append(f"values: {odd}")
    return problems
