"""Type classes of columns and safe column references."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sql import quoted

_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_FLOATING = (T.FloatType, T.DoubleType)


def ref(name: str) -> Column:
    """Reference a column whose name may hold dots or blanks."""
    return F.col(quoted(name))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _DATETIME)]


def type_class(dtype: T.DataType) -> str:
    """Columns of one class can share a long (column, value) table without loss."""
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.DecimalType):
        return dtype.simpleString()  # a class for each precision: a double would merge values
    if isinstance(dtype, T.NumericType):
        return "floating"
    if isinstance(dtype, T.BinaryType):
        return "binary"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.TimestampNTZType):
        return "timestamp_ntz"
    if isinstance(dtype, T.TimestampType):
        return "timestamp"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, T.StringType):
        return "string"
    return "other"


# Spark type that all columns of a class are cast to in a long table.
CLASS_TYPE = {
    "integer": "bigint",
    "floating": "double",
    "boolean": "boolean",
    "timestamp_ntz": "timestamp_ntz",
    "timestamp": "timestamp",
    "date": "date",
    "string": "string",
    "binary": "binary",
}


def class_type(kind: str) -> str | None:
    """The Spark type of a class; None for values that cannot be grouped by."""
    return kind if kind.startswith("decimal") else CLASS_TYPE.get(kind)


def by_class(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, list[str]]:
    """Column names grouped by type class, schema order kept."""
    wanted = set(df.columns if cols is None else cols)
    groups: dict[str, list[str]] = {}
    for field in df.schema:
        kind = type_class(field.dataType)
        if field.name in wanted and class_type(kind):
            groups.setdefault(kind, []).append(field.name)
    return groups


def blocks(items: Sequence, size: int) -> Iterator[list]:
    """Cut a wide column list so that one aggregate stays inside code generation."""
    for start in range(0, len(items), size):
        yield list(items[start : start + size])


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null, nested values become JSON text; all else is untouched."""
    new = {}
    for field in df.schema:
        if isinstance(field.dataType, _FLOATING):
            new[field.name] = F.expr(f"CASE WHEN NOT isnan({quoted(field.name)}) THEN {quoted(field.name)} END")
        elif isinstance(field.dataType, _NESTED):
            new[field.name] = F.to_json(ref(field.name))
    return df.withColumns(new) if new else df


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [name for name in cols if name not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
