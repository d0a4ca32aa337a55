"""Run a registered query beside its reference SQL and compare whole results."""

from __future__ import annotations

import datetime
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()  # fmt: skip


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return float(f"{value!r}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _kind(value) -> str:
    return type(value).__name__


def spark_result(df):
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    return cols, rows


def duck_result(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(r[i] for i in order) for r in cur.fetchall()]


def differences(ours, theirs) -> list[str]:
    (cols_a, rows_a), (cols_b, rows_b) = ours, theirs
    if cols_a != cols_b:
        return [f"columns {cols_a} != {cols_b}"]
    found = []
    for i, c in enumerate(cols_a):
        kinds_a = {_kind(r[i]) for r in rows_a} - {"NoneType"}
        kinds_b = {_kind(r[i]) for r in rows_b} - {"NoneType"}
        if kinds_a and kinds_b and kinds_a != kinds_b:
            found.append(f"type of {c}: {kinds_a} != {kinds_b}")
    a = Counter(tuple(map(_plain, r)) for r in rows_a)
    b = Counter(tuple(map(_plain, r)) for r in rows_b)
    if len(rows_a) != len(rows_b):
        found.append(f"rows {len(rows_a)} != {len(rows_b)}")
    if a != b:
        found.append(f"only ours {list((a - b).items())[:3]}; only reference {list((b - a).items())[:3]}")
    return found
