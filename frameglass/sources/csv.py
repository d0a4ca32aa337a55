"""CSV with type inference that keeps dates as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import sql
from ..functions.kinds import ref
from ..operators.tidy import per_column
from .csv_blocks import stage_csv

# Texts read as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Columns inferred in one parse of the source.
WIDE = 64

_INTEGER = r"^\s*[+-]?\d+\s*$"
_DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def _as_integer(x: str) -> str:
    return f"try_cast(CASE WHEN {x} RLIKE {sql.text(_INTEGER)} THEN trim({x}) END AS BIGINT)"


def _as_double(x: str) -> str:
    """Decimal notation or infinity; texts only Java reads as numbers (`1d`) stay texts."""
    known = f"{x} RLIKE {sql.text(_DECIMAL)} OR {x} RLIKE {sql.text(_INFINITE)}"
    return f"try_cast(CASE WHEN {known} THEN trim({x}) END AS DOUBLE)"


def _as_boolean(x: str) -> str:
    return f"CASE WHEN {x} IN ('True', 'TRUE', 'true') THEN TRUE WHEN {x} IN ('False', 'FALSE', 'false') THEN FALSE END"


_READERS = {"bigint": _as_integer, "double": _as_double, "boolean": _as_boolean}


def read_texts(
    spark: SparkSession, path: str | Sequence[str], multiline: bool = True, staged: bool = False, **options
) -> DataFrame:
    """All columns as text, missing tokens as null."""
    if staged:
        raw = stage_csv(spark, path, **options)
    else:
        settings = {"header": True, "multiLine": multiline, "escape": '"', "encoding": "UTF-8", **options}
        raw = spark.read.options(**settings).csv(path)
    tokens = ", ".join(map(sql.text, NA_TOKENS))
    names = [sql.quoted(c) for c in raw.columns]
    return raw.selectExpr(*[f"CASE WHEN {x} NOT IN ({tokens}) THEN {x} END AS {x}" for x in names])


def infer_types(texts: DataFrame) -> dict[str, str]:
    """The narrowest of bigint, double, boolean that reads every text of a column, else string.

    One aggregate over all columns. A column without values becomes double.
    """
    hits = lambda c, x: {"n": f"count({x})", **{k: f"count({read(x)})" for k, read in _READERS.items()}}
    chosen = {}
    for row in per_column(texts, texts.columns, hits, block=WIDE).collect():
        fits = [kind for kind in _READERS if row[kind] == row["n"]]
        chosen[row["column"]] = "double" if row["n"] == 0 else (fits[0] if fits else "string")
    return chosen


def apply_types(texts: DataFrame, kinds: dict[str, str]) -> DataFrame:
    exprs = []
    for c in texts.columns:
        x = sql.quoted(c)
        exprs.append(f"{_READERS[kinds[c]](x)} AS {x}" if kinds[c] in _READERS else x)
    return texts.selectExpr(*exprs)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    multiline: bool = True,
    staged: bool = False,
    **options,
) -> DataFrame:
    """CSV with a header; numbers and booleans are inferred, dates stay text.

    A quoted field may hold line breaks, so by default a file is one split. With `staged` large files
    are cut into blocks all the same and copied as Parquet, see `stage_csv`, whose options `sep` and `quote` are the
    only ones then. Files without such fields should be read with `multiline=False`, which lets Spark cut
    them; folders of many files are parallel either way. With `schema` the inference
    pass is skipped.
    """
    texts = read_texts(spark, path, multiline, staged, **options)
    if schema is not None:
        given = {f.name: f.dataType for f in schema}
        return texts.select(*[ref(c).try_cast(given[c]).alias(c) for c in texts.columns if c in given])
    return apply_types(texts, infer_types(texts))
