"""Encode categorical columns as numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import sql
from ...functions.kinds import ref
from .base import Needs, Operation, Stats
from .categories import Categories

#: Most 0/1 columns that one column becomes, if no other bound is given.
DENSE_COLUMNS = 10_000
# These choose the plan only; results are the same on either side.
LITERAL_CODES = 64
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def _text(c: str) -> Column:
    return ref(c).cast("string")


def _coded(df: DataFrame, known: Mapping[str, Categories]) -> tuple[DataFrame, dict[str, Column]]:
    """`df`, with code tables joined where there are many values, and the code of each column; null for unknown values."""
    joined, codes = 0, {}
    for c, categories in known.items():
        if categories.values is not None and categories.rows <= LITERAL_CODES:
            codes[c] = _literal(c, categories.values)
            continue
        value, code = f"__v{joined}", f"__c{joined}"
        found = categories.code_table(df).select(F.col("value").alias(value), F.col("code").alias(code))
        # Broadcast only a table whose size was measured when it was fitted; a larger one is joined by
        # shuffle, where adaptive execution splits hot values.
        if categories.rows <= BROADCAST_ROWS and categories.bytes <= BROADCAST_BYTES:
            found = F.broadcast(found)
        df = df.join(found, _text(c) == F.col(value), "left")
        codes[c] = F.col(code)
        joined += 1
    return df, codes


def _literal(c: str, values: Sequence[str]) -> Column:
    if not values:
        return F.lit(None).cast("bigint")
    place = F.array_position(F.array(*[F.lit(v) for v in values]), _text(c))
    return F.nullif(place, F.lit(0)) - 1


class EncodeOneHot(Operation):
    """0/1 columns `{column}_{category}` in sorted order after the rest; null and unseen are all 0.

    As `columns` a table gets as many columns as there are categories; a column with more than `max_categories`, or
    than `DENSE_COLUMNS` without it, raises while fitting, before any value is listed. As `sparse` a table gets one
    column `{column}_onehot` of (size, indices, values), the parts of a sparse vector: any number of categories
    keeps its codes on Spark. Null and unseen have no index.
    """

    name = "encoding.onehot"
    kind = "categorical"

    def __init__(self, cols: Sequence[str] | None = None, max_categories: int | None = None, form: str = "columns") -> None:
        super().__init__(cols)
        if form not in ("columns", "sparse"):
            raise ValueError(f"form {form!r} is neither columns nor sparse")
        self.max_categories, self.form = max_categories, form

    def options(self) -> dict[str, Any]:
        return {"max_categories": self.max_categories, "form": self.form}

    def needs(self, cols: Sequence[str]) -> Needs:
        return Needs(categories=set(cols))

    def learn(self, cols: Sequence[str], stats: Stats) -> None:
        found = {c: stats.categories[c] for c in cols}
        most = self.max_categories
        if most is None and self.form == "columns":
            most = DENSE_COLUMNS
        for c, known in found.items():
            if most is not None and known.rows > most:
                raise ValueError(f"column {c!r} has {known.rows} categories, more than {most}; the sparse form takes any number")
        dense = self.form == "columns"
        self.params = {c: {"categories": known.listed(most) if dense else known} for c, known in found.items()}

    def apply(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        kept = [c for c in df.columns if c not in set(cols)]
        if self.form == "columns":
            dummies = [
                f"CAST(CAST({sql.quoted(c)} AS STRING) <=> {sql.text(v)} AS INT) AS {sql.quoted(f'{c}_{v}')}"
                for c, p in self.params.items()
                for v in p["categories"]
            ]
            return df.selectExpr(*map(sql.quoted, kept), *dummies)
        known = {c: self.params[c]["categories"] for c in cols}
        df, codes = _coded(df, known)
        vectors = [
            F.struct(
                F.lit(known[c].rows).cast("bigint").alias("size"),
                F.array_compact(F.array(code)).alias("indices"),
                F.when(code.isNotNull(), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("values"),
            ).alias(f"{c}_onehot")
            for c, code in codes.items()
        ]
        return df.select(*map(ref, kept), *vectors)


class _Coded(Operation):
    """Value to code; null and unknown values become null."""

    kind = "categorical"

    def apply(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        names = list(df.columns)
        df, codes = _coded(df, {c: self.params[c]["categories"] for c in cols})
        return df.select(*[codes[c].alias(c) if c in codes else ref(c) for c in names])


class EncodeOrdinal(_Coded):
    """Codes in a given order per column, else in sorted order."""

    name = "encoding.ordinal"

    def __init__(
        self, order: Mapping[str, Sequence[str]] | None = None, cols: Sequence[str] | None = None
    ) -> None:
        super().__init__(cols)
        self.order = {k: list(v) for k, v in order.items()} if order else None

    def options(self) -> dict[str, Any]:
        return {"order": self.order}

    def _given(self, c: str) -> list[str] | None:
        return (self.order or {}).get(c) or None

    def needs(self, cols: Sequence[str]) -> Needs:
        return Needs(categories={c for c in cols if not self._given(c)})

    def learn(self, cols: Sequence[str], stats: Stats) -> None:
        self.params = {
            c: {"categories": Categories(values=self._given(c)) if self._given(c) else stats.categories[c]}
            for c in cols
        }


class EncodeLabel(_Coded):
    """Codes 0..k-1 by sorted order."""

    name = "encoding.label"

    def needs(self, cols: Sequence[str]) -> Needs:
        return Needs(categories=set(cols))

    def learn(self, cols: Sequence[str], stats: Stats) -> None:
        self.params = {c: {"categories": stats.categories[c]} for c in cols}
