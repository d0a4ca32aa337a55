"""Scale numeric columns. A constant column becomes one value on every row, nulls included."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Needs, Operation, Stats, number_of, replace_columns


def _shifted(x: Column, centre: float | None, width: float | None, flat: float = 0.0) -> Column:
    """(x - centre) / width; `flat` for a zero width, null for an unknown one."""
    if width == 0:
        return F.lit(flat)
    if centre is None or width is None:
        return F.lit(None).cast("double")
    return (x - F.lit(centre)) / F.lit(width)


class _Scale(Operation):
    kind = "numeric"

    def apply(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        return replace_columns(df, {c: self._scaled(number_of(c), p) for c, p in self.params.items()})

    def _scaled(self, x: Column, p: dict[str, Any]) -> Column:
        return _shifted(x, p["centre"], p["width"])


class ScaleMinMax(_Scale):
    name = "scaling.minmax"

    def __init__(
        self, feature_range: Sequence[float] = (0.0, 1.0), cols: Sequence[str] | None = None
    ) -> None:
        super().__init__(cols)
        self.feature_range = tuple(float(v) for v in feature_range)

    def options(self) -> dict[str, Any]:
        return {"feature_range": list(self.feature_range)}

    def needs(self, cols: Sequence[str]) -> Needs:
        return Needs(aggregates={c: {"min", "max"} for c in cols})

    def learn(self, cols: Sequence[str], stats: Stats) -> None:
        self.params = {}
        for c in cols:
            lo, hi = stats.aggregates[c]["min"], stats.aggregates[c]["max"]
            self.params[c] = {"centre": lo, "width": None if lo is None else hi - lo}

    def _scaled(self, x: Column, p: dict[str, Any]) -> Column:
        lo, hi = self.feature_range
        return _shifted(x, p["centre"], p["width"]) * F.lit(hi - lo) + F.lit(lo)


class ScaleStandard(_Scale):
    name = "scaling.standard"

    def needs(self, cols: Sequence[str]) -> Needs:
        return Needs(aggregates={c: {"mean", "std"} for c in cols})

    def learn(self, cols: Sequence[str], stats: Stats) -> None:
        self.params = {
            c: {"centre": stats.aggregates[c]["mean"], "width": stats.aggregates[c]["std"]} for c in cols
        }


class ScaleRobust(_Scale):
    name = "scaling.robust"

    def needs(self, cols: Sequence[str]) -> Needs:
        return Needs(quantiles={c: {0.25, 0.5, 0.75} for c in cols})

    def learn(self, cols: Sequence[str], stats: Stats) -> None:
        self.params = {}
        for c in cols:
            q = stats.quantiles[c]
            width = None if q[0.5] is None else q[0.75] - q[0.25]
            self.params[c] = {"centre": q[0.5], "width": width}
