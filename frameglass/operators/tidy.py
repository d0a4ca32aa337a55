"""Turn one wide aggregate into a tidy table with a row per column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame

from ..functions import sql
from ..functions.kinds import blocks

# More aggregates than this in one pass make a generated method that the JVM no longer
# compiles, which was measured to cost ten times the time.
AGGREGATES_PER_PASS = 26


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def per_column(
    df: DataFrame,
    cols: Sequence[str],
    metrics: Callable[[str, str], dict[str, str]],
    block: int | None = None,
) -> DataFrame:
    """`metrics(name, x)` gives the aggregates of one column as SQL text; `x` refers to it.

    Columns of a block share one pass without a data shuffle, blocks run side by side.
    On a columnar source each scan reads only its own columns, so all blocks together
    read what one pass would. Row sources are parsed once per block; they pass a
    larger `block`.
    """
    if not cols:
        raise ValueError("per_column needs at least one column")
    if block is None:
        block = max(1, AGGREGATES_PER_PASS // len(metrics(cols[0], sql.quoted(cols[0]))))
    parts = []
    for chunk in blocks(cols, block):
        wide = df.selectExpr(
            *[
                f"{sql.struct({'column': sql.text(c), **metrics(c, sql.quoted(c))})} AS row_{i}"
                for i, c in enumerate(chunk)
            ]
        )
        parts.append(wide.selectExpr(sql.rows([f"row_{i}" for i in range(len(chunk))])))
    return union_all(parts)
