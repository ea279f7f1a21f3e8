"""Compare a Spark result with the DuckDB result of its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        if math.isnan(value):
            return (1, "nan")
        return (1, f"{value + 0.0:.6f}")
    return (1, str(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


_KINDS = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def differences(df, con, sql: str) -> list[str]:
    relation = con.sql(sql)
    columns = relation.columns
    kinds = {c: _KINDS.get(str(t), str(t)) for c, t in zip(columns, relation.types)}
    found = []
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    for name, kind in df.dtypes:
        if kinds[name] != kind:
            found.append(f"type of {name}: {kind} != {kinds[name]}")
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = _rows(columns, relation.fetchall())
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} != {len(theirs)}")
    if ours != theirs:
        missing, extra = sorted(set(theirs) - set(ours))[:2], sorted(set(ours) - set(theirs))[:2]
        found.append(f"values differ; expected {missing} got {extra}")
    return found
