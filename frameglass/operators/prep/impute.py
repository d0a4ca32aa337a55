"""Fill or drop missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.kinds import ref
from .base import Needs, Operation, Stats, number_of, replace_columns


def _present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return F.when(~F.isnan(ref(name)), ref(name)) if floating else ref(name)


class _NumericFill(Operation):
    """Numeric columns become double, as the fill value need not be whole."""

    kind = "numeric"

    def apply(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        fill = {c: F.lit(self.params[c]["value"]).cast("double") for c in cols}
        return replace_columns(df, {c: F.coalesce(number_of(c), fill[c]) for c in cols})


class ImputeMean(_NumericFill):
    name = "missing.mean"

    def needs(self, cols: Sequence[str]) -> Needs:
        return Needs(aggregates={c: {"mean"} for c in cols})

    def learn(self, cols: Sequence[str], stats: Stats) -> None:
        self.params = {c: {"value": stats.aggregates[c]["mean"]} for c in cols}


class ImputeMedian(_NumericFill):
    name = "missing.median"

    def needs(self, cols: Sequence[str]) -> Needs:
        return Needs(quantiles={c: {0.5} for c in cols})

    def learn(self, cols: Sequence[str], stats: Stats) -> None:
        self.params = {c: {"value": stats.quantiles[c][0.5]} for c in cols}


class ImputeMode(Operation):
    """Any type; ties take the smallest value and an empty column stays empty."""

    name = "missing.mode"

    def needs(self, cols: Sequence[str]) -> Needs:
        return Needs(modes=set(cols))

    def learn(self, cols: Sequence[str], stats: Stats) -> None:
        self.params = {c: {"value": stats.modes[c]} for c in cols}

    def apply(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        new = {}
        for c in cols:
            value = self.params[c]["value"]
            if value is not None:
                new[c] = F.coalesce(_present(df, c), F.lit(value).cast(df.schema[c].dataType))
        return replace_columns(df, new)


class ImputeConstant(Operation):
    """One value for all columns, or a value per column; a mapping touches only its keys.

    The value is cast to the column type. A fraction turns a whole-number column to
    double; a value the type cannot hold raises TypeError.
    """

    name = "missing.constant"

    def __init__(self, fill_value: Any = 0, cols: Sequence[str] | None = None) -> None:
        super().__init__(cols)
        self.fill_value = fill_value

    def options(self) -> dict[str, Any]:
        return {"fill_value": self.fill_value}

    def apply(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        values = self.fill_value if isinstance(self.fill_value, Mapping) else dict.fromkeys(cols, self.fill_value)
        new = {c: self._filled(df, c, values[c]) for c in cols if c in values}
        return replace_columns(df, new)

    @staticmethod
    def _filled(df: DataFrame, c: str, value: Any) -> Column:
        dtype, col = df.schema[c].dataType, _present(df, c)
        if isinstance(dtype, T.NumericType):
            try:
                number = float(value)
            except (TypeError, ValueError):
                raise TypeError(f"cannot fill numeric column {c!r} with {value!r}") from None
            if isinstance(dtype, T.IntegralType) and number != int(number):
                dtype = T.DoubleType()
            return F.coalesce(col.cast(dtype), F.lit(value).cast(dtype))
        if isinstance(dtype, T.StringType):
            return F.coalesce(col, F.lit(str(value)))
        return F.coalesce(col, F.lit(value).cast(dtype))


class DropNullRows(Operation):
    """Drop rows with a null in any target."""

    name = "missing.drop_row"

    def apply(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        keep = F.lit(True)
        for c in cols:
            keep = keep & _present(df, c).isNotNull()
        return df.where(keep)


class DropColumns(Operation):
    name = "missing.drop_col"

    def apply(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        gone = set(cols)
        return df.select(*[ref(c) for c in df.columns if c not in gone])
