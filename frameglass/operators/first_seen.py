"""The first distinct values of columns in row order, without moving distinct values.

The first rows of the table show what their values are; a value that they lack comes later. A column that needs more takes
them one by one: of the rows whose value is not found yet, the first one has the next value, and none means that there
are no more. Each step is a plain aggregate over the columns left, so whatever number of distinct values a column has, a
task passes on one row of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sql
from ..functions.kinds import by_class, class_type, require_columns
from ..functions.numbers import not_nan
from .tidy import per_column

FIRST_ROWS = 1_000
_SHORT = 64


def _key(kind: str, x: str) -> tuple[str, str]:
    """What tells the values of a class apart, as SQL text of a plain type, and that type."""
    if kind == "integer":
        return f"CAST({x} AS BIGINT)", "BIGINT"
    if kind == "floating":
        return f"({not_nan(x)} + 0.0D)", "DOUBLE"  # -0.0 is 0.0
    if kind == "boolean":
        return x, "BOOLEAN"
    if kind == "timestamp":
        return f"unix_micros({x})", "BIGINT"
    if kind == "date":
        return f"unix_date({x})", "INT"
    text = f"hex({x})" if kind == "binary" else f"CAST({x} AS STRING)"
    # Digests of long texts are longer than any text that stands for itself.
    return f"CASE WHEN length({text}) <= {_SHORT} THEN {text} ELSE concat('sha256:', sha2({text}, 256)) END", "STRING"


def _shown(kind: str, x: str) -> str:
    if kind == "floating":
        value = f"({not_nan(x)} + 0.0D)"
        return f"CASE WHEN abs({value}) < DOUBLE('Infinity') THEN CAST({value} AS STRING) END"
    return f"CAST(CAST({x} AS {class_type(kind)}) AS STRING)"


def _in_first_rows(
    df: DataFrame, kinds: dict[str, str], order_by: Sequence[str], n: int, rows: int
) -> tuple[dict[str, list], bool]:
    """{column: [(key, shown)]} that the first rows prove, and whether these are all rows."""
    order = f"struct({', '.join(map(sql.quoted, order_by))}) AS __ord"
    cells = [
        sql.struct({"column": sql.text(c), "key": f"CAST({_key(k, sql.quoted(c))[0]} AS STRING)", "shown": _shown(k, sql.quoted(c))})
        for c, k in kinds.items()
    ]
    top = df.selectExpr(order, *map(sql.quoted, kinds)).orderBy("__ord").limit(rows)
    every = Window.partitionBy()  # of so many rows
    # Rows that tie with the last one may lie beyond it, so it proves nothing unless it ends the table.
    proved = top.withColumns({"__n": F.count(F.lit(1)).over(every), "__last": F.max("__ord").over(every)})
    proved = proved.filter((F.col("__ord") < F.col("__last")) | (F.col("__n") < rows))
    firsts = proved.selectExpr("__ord AS ord", "__n AS n_rows", sql.rows(cells)).groupBy("column", "key").agg(
        F.min("ord").alias("ord"), F.first("shown").alias("shown"), F.first("n_rows").alias("n_rows"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("ord", "key")).alias("place")
    listed = firsts.select("column", "key", "shown", "n_rows", place).filter(F.col("place") <= n).orderBy("place").collect()
    found: dict[str, list] = {c: [] for c in kinds}
    for r in listed:
        found[r["column"]].append((r["key"], r["shown"]))
    return found, any(r["n_rows"] < rows for r in listed)


def _next_value(kind: str, x: str, found: Sequence[tuple], order_by: Sequence[str]) -> dict[str, str]:
    """The value of the first row whose value is not among those found."""
    key, dtype = _key(kind, x)
    texts = [k for k, _ in found if k is not None]
    new = f"({key}) NOT IN ({', '.join(f'CAST({sql.text(k)} AS {dtype})' for k in texts)})" if texts else "TRUE"
    other = "FALSE" if len(texts) < len(found) else "TRUE"
    row = sql.struct({"ord": f"struct({', '.join(map(sql.quoted, order_by))})", "key": key, "shown": _shown(kind, x)})
    first = f"min(CASE WHEN CASE WHEN ({key}) IS NULL THEN {other} ELSE {new} END THEN {row} END)"
    return {"more": f"{first} IS NOT NULL", "key": f"CAST({first}.key AS STRING)", "shown": f"{first}.shown"}


def first_values(
    df: DataFrame, cols: Sequence[str], order_by: Sequence[str], n: int = 10, first_rows: int = FIRST_ROWS
) -> DataFrame:
    """(column, rank, value): the first `n` distinct values in row order, as text; null counts, NaN is null.

    Rows that tie in `order_by` give their smaller value first. At most `n` scans after the first; only columns that still
    lack values are read again. The values found, `n` a column, are on the driver.
    """
    require_columns(df, [*cols, *order_by])
    if not order_by:
        raise ValueError("name the columns that give the order of rows")
    kinds = {c: kind for kind, names in by_class(df, cols).items() for c in names}
    found, ended = _in_first_rows(df, kinds, order_by, n, first_rows) if kinds else ({}, True)
    left = [] if ended else [c for c in kinds if len(found[c]) < n]
    while left:
        nexts = per_column(df, left, lambda c, x: _next_value(kinds[c], x, found[c], order_by))
        more = {r["column"]: (r["key"], r["shown"]) for r in nexts.collect() if r["more"]}
        for c, value in more.items():
            found[c].append(value)
        left = [c for c in left if c in more and len(found[c]) < n]
    rows = [(c, i, shown) for c, values in found.items() for i, (_, shown) in enumerate(values, 1)]
    return df.sparkSession.createDataFrame(rows, "column string, rank int, value string")
