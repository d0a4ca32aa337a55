"""Univariate statistics of string columns, all from one value-count table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import categorical_columns
from .value_counts import mode_table, top_n, value_counts

TOP = 5
RARE_SHARE = 0.01
ENTROPY_SHIFT = 1e-9


def column_totals(vc: DataFrame) -> DataFrame:
    """(column, n, cardinality): mergeable aggregates of the value counts."""
    return vc.groupBy("column").agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("cardinality"))


def _shares(vc: DataFrame) -> DataFrame:
    # The totals hold one row per column of the table, so their size is bounded.
    totals = vc.groupBy("column").agg(F.sum("cnt").alias("n"))
    return vc.join(F.broadcast(totals), "column").withColumn("p", F.col("cnt") / F.col("n"))


def entropy_and_rarity(vc: DataFrame) -> DataFrame:
    p = F.col("p")
    return _shares(vc).groupBy("column").agg(
        (-F.sum(p * F.log2(p + F.lit(ENTROPY_SHIFT)))).alias("entropy"),
        (F.coalesce(F.sum(F.when(p < RARE_SHARE, p)), F.lit(0.0)) * 100).alias("rare_pct"),
    )


def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(column, n, cardinality, mode, entropy, rare_pct) of columns that hold a value.

    All parts hang on the same shuffle of the value counts, which adaptive execution
    runs once, or on the table `counts` of them.
    """
    vc = value_counts(df, categorical_columns(df) if cols is None else cols) if counts is None else counts
    return (
        column_totals(vc)
        .join(F.broadcast(mode_table(vc)), "column")
        .join(F.broadcast(entropy_and_rarity(vc)), "column")
    )


def top_values(
    df: DataFrame, cols: Sequence[str] | None = None, n: int = TOP, order_by: Sequence[str] = (), counts: DataFrame | None = None
) -> DataFrame:
    """(column, rank, value, cnt, pct); ties go to the value seen first by `order_by`, else the smaller.

    `counts` are the value counts if they are at hand, with `first_seen` for an order.
    """
    vc = value_counts(df, categorical_columns(df) if cols is None else cols, order_by) if counts is None else counts
    totals = vc.groupBy("column").agg(F.sum("cnt").alias("n"))
    ties = [F.col("first_seen").asc()] if order_by else []
    best = top_n(vc, n, F.col("cnt").desc(), *ties, F.col("value").asc())
    return best.join(F.broadcast(totals), "column").select(
        "column", "rank", "value", "cnt", (F.col("cnt") * 100.0 / F.col("n")).alias("pct")
    )
