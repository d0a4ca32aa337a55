"""Numeric expressions as SQL text; none raises under ANSI mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .sql import quoted


def finite(x: str) -> str:
    """The value as double, or null when it is null, NaN or infinite."""
    d = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN NOT isnan({d}) AND abs({d}) < DOUBLE('Infinity') THEN {d} END"


def not_nan(x: str) -> str:
    """The value as double, NaN read as null; infinities stay."""
    d = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN NOT isnan({d}) THEN {d} END"


def finite_view(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), value=finite) -> DataFrame:
    """The columns as doubles that hold only usable values, beside untouched key columns."""
    return df.selectExpr(
        *[quoted(k) for k in keep if k not in cols], *[f"{value(quoted(c))} AS {quoted(c)}" for c in cols]
    )


def _zero_when_flat(value: str, x: str, least: int) -> str:
    """Shape of a constant column is 0 once it has `least` values, null before."""
    return f"CASE WHEN count({x}) < {least} THEN NULL WHEN min({x}) = max({x}) THEN 0.0D ELSE {value} END"


def sample_skewness(x: str) -> str:
    """Bias-adjusted skewness G1 from the population moment Spark offers."""
    n = f"CAST(count({x}) AS DOUBLE)"
    return _zero_when_flat(f"try_divide(skewness({x}) * sqrt({n} * ({n} - 1)), {n} - 2)", x, 3)


def sample_kurtosis(x: str) -> str:
    """Bias-adjusted excess kurtosis G2."""
    n = f"CAST(count({x}) AS DOUBLE)"
    adjusted = f"try_divide((({n} + 1) * kurtosis({x}) + 6) * ({n} - 1), ({n} - 2) * ({n} - 3))"
    return _zero_when_flat(adjusted, x, 4)


def share_pct(part: str, whole: str) -> str:
    """100 * part / whole, 0 on an empty whole."""
    return f"coalesce(try_divide({part} * 100.0D, {whole}), 0.0D)"


def shape_hint(skew: str) -> str:
    return (
        f"CASE WHEN {skew} > 0.5 THEN 'right-skewed' WHEN {skew} < -0.5 THEN 'left-skewed' "
        "ELSE 'approximately-normal' END"
    )
