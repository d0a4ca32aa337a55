"""The fit/transform contract and the statistics that fits ask for.

`fit` reduces a table to a few numbers per column; `transform` is a projection or a
filter with those numbers as literals, so it stays in code generation, needs no
join and works on streams.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.kinds import require_columns
from ...functions.numbers import finite_view, not_nan
from ...functions.sql import quoted
from ..quantiles import exact_quantiles
from ..tidy import per_column
from ..value_counts import modes

_AGGREGATES = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


@dataclass
class Needs:
    """Statistics an operation wants from its input."""

    aggregates: dict[str, set[str]] = field(default_factory=dict)
    quantiles: dict[str, set[float]] = field(default_factory=dict)
    modes: set[str] = field(default_factory=set)
    categories: set[str] = field(default_factory=set)

    def merge(self, other: Needs) -> Needs:
        def united(a: Mapping[str, set], b: Mapping[str, set]) -> dict[str, set]:
            return {k: a.get(k, set()) | b.get(k, set()) for k in {**a, **b}}

        return Needs(
            united(self.aggregates, other.aggregates),
            united(self.quantiles, other.quantiles),
            self.modes | other.modes,
            self.categories | other.categories,
        )


@dataclass
class Stats:
    aggregates: dict[str, dict[str, float | None]] = field(default_factory=dict)
    quantiles: dict[str, dict[float, float | None]] = field(default_factory=dict)
    modes: dict[str, Any] = field(default_factory=dict)
    categories: dict[str, Any] = field(default_factory=dict)


def collect_stats(df: DataFrame, needs: Needs) -> Stats:
    """All wanted statistics: one pass for the aggregates, one for the quantiles and
    one shuffle each for modes and categories."""
    from .categories import learn_categories

    stats = Stats()
    if needs.aggregates:
        cols = [c for c in df.columns if c in needs.aggregates]
        tidy = per_column(
            finite_view(df, cols, value=not_nan),
            cols,
            lambda c, x: {name: f"{fn}({x})" for name, fn in _AGGREGATES.items()},
        )
        stats.aggregates = {r["column"]: r.asDict() for r in tidy.collect()}
    if needs.quantiles:
        stats.quantiles = exact_quantiles(df, {c: sorted(p) for c, p in needs.quantiles.items()})
    if needs.modes:
        stats.modes = modes(df, [c for c in df.columns if c in needs.modes])
    if needs.categories:
        stats.categories = learn_categories(df, [c for c in df.columns if c in needs.categories])
    return stats


def number_of(name: str) -> Column:
    """A numeric column as double, NaN read as null."""
    return F.expr(not_nan(quoted(name)))


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """`df` with some columns computed anew, order kept."""
    return df.withColumns(dict(new)) if new else df


class Operation:
    """A column operation that learns from one table and applies to any."""

    name: ClassVar[str]
    kind: ClassVar[str] = "any"  # any, numeric or categorical

    def __init__(self, cols: Sequence[str] | None = None) -> None:
        self.cols = None if cols is None else list(cols)
        self.params: dict[str, dict[str, Any]] | None = None

    def options(self) -> dict[str, Any]:
        """Arguments that rebuild the operation, besides `cols`."""
        return {}

    def resolve(self, df: DataFrame) -> list[str]:
        return list(df.columns) if self.cols is None else self.cols

    def validate(self, df: DataFrame, cols: Sequence[str]) -> None:
        require_columns(df, cols)
        number = {f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
        if self.kind == "numeric" and (wrong := [c for c in cols if c not in number]):
            raise TypeError(f"{self.name} works on numbers; these columns hold none: {wrong}")
        if self.kind == "categorical" and (wrong := [c for c in cols if c in number]):
            raise TypeError(f"{self.name} works on categories; these columns hold numbers: {wrong}")

    def needs(self, cols: Sequence[str]) -> Needs:
        return Needs()

    def learn(self, cols: Sequence[str], stats: Stats) -> None:
        self.params = {c: {} for c in cols}

    def apply(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        raise NotImplementedError

    def prepare(self, df: DataFrame) -> tuple[list[str], Needs]:
        cols = self.resolve(df)
        self.validate(df, cols)
        return cols, self.needs(cols)

    def fit(self, df: DataFrame) -> Operation:
        cols, needs = self.prepare(df)
        self.learn(cols, collect_stats(df, needs))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.params is None:
            raise RuntimeError(f"fit {type(self).__name__} before transform")
        return self.apply(df, self.resolve(df))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def __repr__(self) -> str:
        shown = ", ".join(f"{k}={v!r}" for k, v in {**self.options(), "cols": self.cols}.items())
        return f"{type(self).__name__}({shown})"
