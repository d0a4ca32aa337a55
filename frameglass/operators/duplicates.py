"""Rows equal to an earlier row, counted in one pass over 256-bit row digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import normalise
from ..functions.numbers import share_pct
from ..functions.sql import quoted



def _digest(df: DataFrame) -> list[str]:
    """Four independent 64-bit row hashes; each takes in which values are null, as hashes pass over nulls."""
    names = [quoted(c) for c in df.columns]
    gaps = [f"{x} IS NULL" for x in names]
    return [f"xxhash64({', '.join([str(seed), *gaps, *names])}) AS h{seed}" for seed in range(4)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(duplicate_rows, duplicate_pct), null equal to null, NaN read as null.

    Rows are equal when their 256-bit digests are. Repeats collapse in each task, and one shuffle moves
    32 bytes of each row that is left; whole rows never move.
    """
    seen = normalise(df).selectExpr(*_digest(df)).groupBy("h0", "h1", "h2", "h3").agg(F.count(F.lit(1)).alias("cnt"))
    totals = seen.selectExpr("coalesce(sum(cnt - 1), 0) AS duplicate_rows", "coalesce(sum(cnt), 0) AS n")
    return totals.selectExpr("duplicate_rows", f"{share_pct('duplicate_rows', 'n')} AS duplicate_pct")
