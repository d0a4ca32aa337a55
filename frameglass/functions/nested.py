"""Flatten nested rows and write lists as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kinds import ref


def list_text(col: Column, element: T.DataType) -> Column:
    """JSON text of a list with `", "` between items, as a JSON dump writes it."""
    if isinstance(element, T.ArrayType):
        item = lambda x: F.coalesce(list_text(x, element.elementType), F.lit("null"))
    elif isinstance(element, (T.StructType, T.MapType)):
        item = lambda x: F.coalesce(F.to_json(x), F.lit("null"))
    else:
        # to_json of a one-item list quotes and escapes the scalar; strip its brackets.
        item = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", "$1")
    return F.when(
        col.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(col, item), ", "), F.lit("]"))
    )


def _leaves(col: Column, name: str, dtype: T.DataType) -> list[Column]:
    if isinstance(dtype, T.StructType):
        found: list[Column] = []
        for field in dtype.fields:
            found += _leaves(col.getField(field.name), f"{name}.{field.name}", field.dataType)
        return found
    if isinstance(dtype, T.ArrayType):
        return [list_text(col, dtype.elementType).alias(name)]
    if isinstance(dtype, T.MapType):
        return [F.to_json(col).alias(name)]
    return [col.alias(name)]


def flatten(df: DataFrame) -> DataFrame:
    """Structs become dotted columns, lists become JSON text."""
    out: list[Column] = []
    for field in df.schema:
        out += _leaves(ref(field.name), field.name, field.dataType)
    return df.select(*out)
