"""The shared (column, value, count) core and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sql
from ..functions.kinds import by_class, class_type
from ..functions.numbers import not_nan
from .tidy import per_column, union_all


def long_values(
    df: DataFrame,
    cols: Sequence[str],
    order_by: Sequence[str] = (),
    cast: str | None = None,
) -> DataFrame:
    """(column, value[, ord]) with a row per cell, nulls included; NaN is null."""
    if cast is None:
        groups = by_class(df, cols)
        if len(groups) != 1:
            raise ValueError(f"columns of one type class expected, got {sorted(groups)}")
        cast = class_type(next(iter(groups)))
    keys = [f"struct({', '.join(map(sql.quoted, order_by))}) AS ord"] if order_by else []
    value = not_nan if cast == "double" else (lambda x: f"CAST({x} AS {cast})")
    cells = [sql.struct({"column": sql.text(c), "value": value(sql.quoted(c))}) for c in cols]
    return df.selectExpr(*keys, sql.rows(cells))


def value_counts(
    df: DataFrame,
    cols: Sequence[str],
    order_by: Sequence[str] = (),
    keep_nulls: bool = False,
    cast: str | None = None,
) -> DataFrame:
    """(column, value, cnt[, first_seen]) of columns of one type class.

    One shuffle with map-side combine for all columns: a hot value collapses to
    one row per task before it moves.
    """
    long = long_values(df, cols, order_by, cast)
    if not keep_nulls:
        long = long.where(F.col("value").isNotNull())
    aggs: list[Column] = [F.count(F.lit(1)).alias("cnt")]
    if order_by:
        aggs.append(F.min("ord").alias("first_seen"))
    return long.groupBy("column", "value").agg(*aggs)


def n_unique(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column, n_unique): exact distinct non-null values, or a sketch on request; null for nested columns."""
    if approximate:
        return per_column(df, cols, lambda c, x: {"n_unique": f"approx_count_distinct({x})"})
    parts = [
        value_counts(df, names).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
        for names in by_class(df, cols).values()
    ]
    seen = union_all(parts)
    # Columns without any value have no group; a one-row-per-column frame restores them.
    counted = {c for names in by_class(df, cols).values() for c in names}
    names = df.sparkSession.createDataFrame([(c, c in counted) for c in cols], "column string, counted boolean")
    return names.join(seen, "column", "left").select(
        "column", F.expr("CASE WHEN counted THEN coalesce(n_unique, 0) END").cast("bigint").alias("n_unique")
    )


def mode_table(vc: DataFrame) -> DataFrame:
    """(column, mode): the most frequent value, ties to the smallest.

    The highest count is a plain hash aggregate; only the values that reach it are
    compared. The counts hold one row per column, so they are broadcast.
    """
    highest = vc.groupBy("column").agg(F.max("cnt").alias("cnt"))
    return (
        vc.join(F.broadcast(highest), ["column", "cnt"], "left_semi")
        .groupBy("column")
        .agg(F.min("value").alias("mode"))
    )


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """{column: mode or None}; one small row per column reaches the driver."""
    found: dict[str, object] = dict.fromkeys(cols)
    for names in by_class(df, cols).values():
        found.update({r["column"]: r["mode"] for r in mode_table(value_counts(df, names)).collect()})
    return found


def top_n(vc: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first `n` values per column; `rank` starts at 1.

    Spark keeps `n` rows per column in each task before the shuffle (window group
    limit), so a column with billions of values costs `n` rows per task.
    """
    window = Window.partitionBy("column").orderBy(*order)
    return vc.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
