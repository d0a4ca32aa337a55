"""Univariate numeric statistics over finite values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.kinds import numeric_columns
from ..functions.numbers import finite, finite_view, sample_kurtosis, sample_skewness, share_pct
from ..functions.sql import number
from .quantiles import exact_quantiles
from .tidy import per_column

FENCE_REACH = 1.5


@dataclass(frozen=True)
class Fence:
    """Quartiles of a column; the limits lie 1.5 quartile ranges outside them."""

    q1: float
    median: float
    q3: float

    @property
    def lower(self) -> float:
        return self.q1 - FENCE_REACH * (self.q3 - self.q1)

    @property
    def upper(self) -> float:
        return self.q3 + FENCE_REACH * (self.q3 - self.q1)

    def outside(self, x: str) -> str:
        return f"({x} < {number(self.lower)} OR {x} > {number(self.upper)})"


def fit_fences(df: DataFrame, cols: Sequence[str]) -> dict[str, Fence | None]:
    """Three numbers per column on the driver, used as literals by later passes."""
    found = exact_quantiles(df, {c: (0.25, 0.5, 0.75) for c in cols}, value=finite)
    return {
        c: None if q[0.5] is None else Fence(q[0.25], q[0.5], q[0.75]) for c, q in found.items()
    }


def _metrics(x: str, fence: Fence | None) -> dict[str, str]:
    """All metrics of a column of usable doubles, as SQL text."""
    outside = f"count_if({fence.outside(x)})" if fence else "count_if(FALSE)"
    quartile = lambda name: f"max({number(getattr(fence, name) if fence else None)})"
    return {
        "n": f"count({x})",
        "mean": f"avg({x})",
        "median": quartile("median"),
        "std": f"stddev_samp({x})",
        "min": f"min({x})",
        "max": f"max({x})",
        "p25": quartile("q1"),
        "p75": quartile("q3"),
        "skewness": sample_skewness(x),
        "kurtosis": sample_kurtosis(x),
        "zeros_pct": f"try_divide(count_if({x} = 0) * 100.0D, count({x}))",
        "outlier_count": outside,
        "outlier_pct": share_pct(outside, f"count({x})"),
    }


METRICS = ("n", "mean", "median", "std", "min", "max", "p25", "p75", "skewness", "kurtosis",
           "zeros_pct", "outlier_count", "outlier_pct")
_NEED_FENCES = {"median", "p25", "p75", "outlier_count", "outlier_pct"}


def numeric_profile(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    metrics: Sequence[str] = METRICS,
    fences: dict[str, Fence | None] | None = None,
) -> DataFrame:
    """A row per numeric column: (column, metric…).

    Moments, zero share and outlier counts come from one aggregate; the quartiles
    cost their own pass and only run when a chosen metric needs them.
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    if fences is None:
        fences = fit_fences(df, cols) if _NEED_FENCES & set(metrics) else {}
    def chosen(c: str, x: str) -> dict[str, str]:
        known = _metrics(x, fences.get(c))
        return {m: known[m] for m in metrics}

    return per_column(finite_view(df, cols), cols, chosen)


def quantile_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, p25, median, p75), exact."""
    rows = [
        (c, f and f.q1, f and f.median, f and f.q3) for c, f in fit_fences(df, cols).items()
    ]
    return df.sparkSession.createDataFrame(rows, "column string, p25 double, median double, p75 double")
