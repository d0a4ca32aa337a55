"""Shared pieces of the registered queries and their reference SQL.

Both sides round floating results to six digits, as sums differ in the last bits
with the order of rows. Results with a value per row round to four: among that many
values some would lie on a rounding edge of the sixth digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sql import quoted

Query = Callable[[SparkSession, str], DataFrame]

LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

# Nulls planted by value in a table that has none; the text reads the same in both engines.
PLANTED_LINES = (
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, "
    "nullif(l_discount, CAST(0 AS DOUBLE)) AS l_discount, "
    "CASE WHEN l_tax > CAST(0.06 AS DOUBLE) THEN NULL ELSE l_extendedprice END AS l_extendedprice, "
    "CASE WHEN l_quantity > 45 THEN NULL ELSE l_returnflag END AS l_returnflag, "
    "CASE WHEN l_quantity < 3 THEN NULL ELSE l_linestatus END AS l_linestatus, "
    "CASE WHEN l_quantity > 30 THEN NULL ELSE l_linenumber END AS l_line FROM {lineitem}"
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def planted_lines(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(PLANTED_LINES, lineitem=table(spark, sf, "lineitem"))


PLANTED_SQL = PLANTED_LINES.format(lineitem="lineitem")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.expr(f"round({quoted(c)}, {digits})") for c in doubles}) if doubles else df


ROW_DIGITS = 4


def rounded_rows(df: DataFrame) -> DataFrame:
    return rounded(df, ROW_DIGITS)


def union_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def per_number(expr: str, cols: list[str] = LINE_NUMBERS, source: str = "lineitem") -> str:
    """Reference SQL: the aggregates `expr` over `x` for every column, in tidy form."""
    return union_sql(
        [f"SELECT '{c}' AS \"column\", {expr} FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {source}) t" for c in cols]
    )


def fences_sql(c: str, source: str = "lineitem") -> str:
    """Reference SQL: one row with the limits of a column."""
    return (
        f"SELECT q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence, q1, q3 FROM "
        f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 "
        f"FROM {source}) f"
    )
