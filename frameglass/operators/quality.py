"""The weighted data quality score and its flags, from small tidy tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import normalise, numeric_columns
from ..functions.numbers import finite_view
from ..functions.sql import quoted
from .duplicates import duplicate_rows
from .numeric import Fence, fit_fences
from .tidy import union_all

# Weights of the four sub-scores and the flag thresholds.
WEIGHTS = {"completeness": 0.35, "uniqueness": 0.25, "consistency": 0.25, "timeliness": 0.15}
NULL_FLAG_PCT = 5.0
DUPLICATE_FLAG_PCT = 1.0


def _share_left(part: str, whole: str) -> str:
    return f"1.0D - coalesce(try_divide(CAST({part} AS DOUBLE), CAST({whole} AS DOUBLE)), 0.0D)"


def completeness(df: DataFrame) -> DataFrame:
    """1 - nulls / cells."""
    flat = normalise(df)
    nulls = " + ".join(f"count_if({quoted(c)} IS NULL)" for c in flat.columns)
    return flat.selectExpr(f"{_share_left(f'({nulls})', f'(count(1) * {len(flat.columns)})')} AS completeness")


def uniqueness(df: DataFrame) -> DataFrame:
    """1 - duplicate rows / rows."""
    return duplicate_rows(df).selectExpr("1.0D - duplicate_pct / 100 AS uniqueness")


def consistency(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    fences: Mapping[str, Fence | None] | None = None,
) -> DataFrame:
    """1 - mean over numeric columns of outliers / all rows; columns without values do not count."""
    cols = numeric_columns(df) if cols is None else list(cols)
    fences = fit_fences(df, cols) if fences is None else fences
    cols = [c for c in cols if fences[c]]
    if not cols:
        return df.sparkSession.createDataFrame([(1.0,)], "consistency double")
    hits = " + ".join(f"count_if({fences[c].outside(quoted(c))})" for c in cols)
    return finite_view(df, cols).selectExpr(
        f"{_share_left(f'({hits})', f'(count(1) * {len(cols)})')} AS consistency"
    )


def timeliness(datetimes: DataFrame) -> DataFrame:
    """Mean over datetime columns of 1 - gaps / range in days; 1 without a frequency."""
    days = "greatest(coalesce(date_range_days, 1), 1)"
    score = (
        "CASE WHEN gaps_count IS NULL OR inferred_freq IS NULL THEN 1.0D "
        f"ELSE 1.0D - least(CAST(gaps_count AS DOUBLE) / {days}, 1.0D) END"
    )
    return datetimes.selectExpr(f"coalesce(avg({score}), 1.0D) AS timeliness")


def overall(scores: DataFrame) -> DataFrame:
    """Adds `overall_score` to a table that holds the four sub-scores."""
    # The score combines sub-scores that were rounded to 4 digits.
    total = sum((F.round(F.col(name), 4) * w for name, w in WEIGHTS.items()), F.lit(0.0))
    return scores.withColumn("overall_score", total)


def quality_flags(missing: DataFrame, duplicates: DataFrame, datetimes: DataFrame) -> DataFrame:
    """(kind, column, flag): high nulls, duplicate rows, datetime gaps."""
    # A rounded double prints without trailing zeros but one.
    nulls = missing.where(f"round(null_pct, 2) > {NULL_FLAG_PCT}").selectExpr(
        "'nulls' AS kind", "column", "concat('high null in \\'', column, '\\' (', round(null_pct, 2), '%)') AS flag"
    )
    dups = duplicates.where(f"round(duplicate_pct, 2) > {DUPLICATE_FLAG_PCT}").selectExpr(
        "'duplicates' AS kind",
        "CAST(NULL AS STRING) AS column",
        "concat('duplicate rows: ', round(duplicate_pct, 2), '%') AS flag",
    )
    gaps = datetimes.where("gaps_count > 0").selectExpr(
        "'gaps' AS kind", "column", "concat(gaps_count, ' datetime gaps in \\'', column, '\\'') AS flag"
    )
    return union_all([nulls, dups, gaps])
