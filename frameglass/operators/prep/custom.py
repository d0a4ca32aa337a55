"""User-supplied steps: a DataFrame function, SQL expressions, or pandas batches."""

from __future__ import annotations

import inspect
import traceback
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from .base import Operation


class CustomTransform(Operation):
    """`fn(df) -> df` over Spark columns; errors name the user's line."""

    name = "custom.function"

    def __init__(self, fn: Callable[[DataFrame], DataFrame]) -> None:
        if not callable(fn):
            raise ValueError("a custom step needs a callable transform(df)")
        super().__init__(None)
        self.fn = fn

    def apply(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        try:
            result = self.fn(df)
        except Exception as error:
            raise RuntimeError(f"{type(error).__name__} at {self._place(error)}\n{error}") from error
        if not isinstance(result, DataFrame):
            raise TypeError(f"the custom step must return a DataFrame, got {type(result).__name__}")
        return result

    def _place(self, error: Exception) -> str:
        frames = traceback.extract_tb(error.__traceback__)
        try:
            source = inspect.getsourcefile(self.fn) or inspect.getfile(self.fn)
        except TypeError:
            source = None
        own = [f for f in frames if f.filename == source and f.name != "apply"]
        frame = own[-1] if own else frames[-1]
        return f"line {frame.lineno}: {frame.line}" if frame.line else f"line {frame.lineno}"


class SqlTransform(Operation):
    """A projection written as SQL expressions; the form of a custom step that can be saved."""

    name = "custom.sql"

    def __init__(self, exprs: Sequence[str]) -> None:
        if not exprs or not all(e.strip() for e in exprs):
            raise ValueError("custom expressions cannot be empty")
        super().__init__(None)
        self.exprs = list(exprs)

    def options(self) -> dict[str, Any]:
        return {"exprs": self.exprs}

    def apply(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        return df.selectExpr(*self.exprs)


class PandasTransform(Operation):
    """Row-wise pandas code over Arrow batches of each partition."""

    name = "custom.pandas"

    def __init__(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> None:
        super().__init__(None)
        self.fn, self.schema = fn, schema

    def apply(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        fn = self.fn

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield fn(batch)

        return df.mapInPandas(run, self.schema)
