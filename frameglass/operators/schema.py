"""Table shape, logical size, column types and null counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import normalise
from ..functions.numbers import share_pct
from ..functions.sql import quoted
from .tidy import per_column

# Bytes a value of each fixed-width type takes.
_WIDTH = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
    "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}

_DTYPE = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32",
          "double": "float64", "boolean": "bool", "string": "object", "timestamp": "datetime64[us]",
          "timestamp_ntz": "datetime64[us]", "date": "datetime64[us]"}

_LABEL = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer",
          "float": "floating", "double": "floating", "boolean": "boolean", "string": "string",
          "timestamp": "datetime64", "timestamp_ntz": "datetime64", "date": "datetime64"}


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def _bytes_of(field: T.StructField) -> str:
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return f"coalesce(sum(octet_length({quoted(field.name)})), 0)"
    return f"count(1) * {_WIDTH.get(field.dataType.simpleString(), 16)}"


def logical_size(df: DataFrame) -> DataFrame:
    """(logical_bytes, logical_mb): fixed widths plus string bytes, nulls at their width."""
    flat = normalise(df)
    total = " + ".join(_bytes_of(f) for f in flat.schema)
    return flat.selectExpr(f"CAST({total} AS BIGINT) AS logical_bytes").selectExpr(
        "logical_bytes", "logical_bytes / (1024.0D * 1024.0D) AS logical_mb"
    )


def column_types(df: DataFrame) -> DataFrame:
    """(column, ordinal, dtype, inferred_type); a column without values is `empty`.

    Only strings can be empty: a typed column keeps its type.
    """
    flat = normalise(df)
    rows = []
    for i, field in enumerate(flat.schema):
        kind = field.dataType.simpleString()
        label = "decimal" if isinstance(field.dataType, T.DecimalType) else _LABEL.get(kind, kind)
        rows.append((field.name, i, _DTYPE.get(kind, kind), label))
    named = flat.sparkSession.createDataFrame(
        rows, "column string, ordinal int, dtype string, label string"
    )
    filled = per_column(flat, flat.columns, lambda c, x: {"n": f"count({x})"})
    label = F.when((F.col("n") == 0) & (F.col("label") == "string"), "empty").otherwise(F.col("label"))
    return named.join(filled, "column").select(
        "column", "ordinal", "dtype", label.alias("inferred_type")
    )


def null_counts(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """(column, null_count, null_pct of all rows); columns without nulls are left out."""
    flat = normalise(df)
    tidy = per_column(
        flat,
        flat.columns,
        lambda c, x: {
            "null_count": f"count_if({x} IS NULL)",
            "null_pct": share_pct(f"count_if({x} IS NULL)", "count(1)"),
        },
    )
    return tidy.where("null_count > 0") if only_missing else tidy
