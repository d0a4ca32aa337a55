"""Choose a reader by extension; look at, validate and preview a source."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sql
from ..functions.kinds import ref
from .csv import read_csv
from .nested import read_json, read_jsonl

EXTENSIONS = (".csv", ".json", ".jsonl", ".parquet")
PROBE_ROWS = 5
PREVIEW_ROWS = 100
KIND_ROWS = 20


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


_READERS = {".csv": read_csv, ".json": read_json, ".jsonl": read_jsonl, ".parquet": read_parquet}


def extension(path: str) -> str:
    """The format suffix of a file, folder or glob; raises on any other."""
    name = path.rstrip("/*").lower()
    found = [e for e in EXTENSIONS if name.endswith(e)]
    if not found:
        raise ValueError(f"no reader for {path}: expected one of {EXTENSIONS}")
    return found[0]


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by extension; options go to the reader of the format, such as `multiline=False` for CSV."""
    return _READERS[extension(path)](spark, path, **options)


def source_meta(df: DataFrame) -> DataFrame:
    """(source, file_format, n_rows, read_at): one row per input file of a file-based table."""
    name = F.col("_metadata.file_name")
    return (
        df.groupBy(name.alias("source"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("file_format", F.regexp_extract("source", r"(\.[A-Za-z0-9]+)$", 1))
        .withColumn("read_at", F.lit(datetime.now(timezone.utc).isoformat()))
    )


def _hashable(field: T.StructField) -> str:
    """SQL that needs all of a column; maps and nested values are hashed as text."""
    nested = isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))
    return f"to_json({sql.quoted(field.name)})" if nested else sql.quoted(field.name)


def validate_source(spark: SparkSession, path: str, multiline: bool = True) -> None:
    """Raise ValueError unless the extension is known and the source can be read.

    Every value of a Parquet source is decoded, in one distributed pass. JSON is parsed whole to infer its
    columns. Of CSV the header and the first rows are read; `corrupt_rows` checks all of them. `multiline` as in `read_csv`.
    """
    kind = extension(path)
    reader = spark.read.option("mode", "FAILFAST")
    try:
        if kind == ".csv":
            probe = reader.options(header=True, multiLine=multiline, escape='"').csv(path)
        elif kind == ".parquet":
            probe = reader.parquet(path)
        else:
            probe = reader.option("multiLine", kind == ".json").json(path)
        if not probe.columns:
            raise ValueError("no columns")
        if kind == ".parquet":
            probe.selectExpr(f"bit_xor(xxhash64({', '.join(['1', *map(_hashable, probe.schema)])}))").collect()
        else:
            probe.limit(PROBE_ROWS).collect()
    except Exception as error:
        raise ValueError(f"cannot read {path}: {error}") from error


def corrupt_rows(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True) -> DataFrame:
    """(n_rows, n_corrupt, n_filled): rows of a JSON Lines or CSV source that do not fit
    `schema`, and rows whose first field holds a value. A CSV file is split among tasks only without
    `multiline`, for files whose fields hold no line breaks."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.read.schema(marked).option("mode", "PERMISSIVE")
    if extension(path) == ".csv":
        rows = reader.options(header=True, multiLine=multiline, escape='"').csv(path)
    else:
        rows = reader.json(path)
    # Spark only parses, and so only checks, a row when a field of it is asked for.
    return rows.selectExpr(
        "count(1) AS n_rows",
        "count_if(_corrupt_record IS NOT NULL) AS n_corrupt",
        f"count({sql.quoted(schema.fields[0].name)}) AS n_filled",
    )


def null_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite values become null, as the output formats cannot hold them."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    keep = lambda x: f"CASE WHEN NOT isnan({x}) AND abs({x}) < DOUBLE('Infinity') THEN {x} END"
    return df.withColumns({c: F.expr(keep(sql.quoted(c))) for c in floats}) if floats else df


def preview(df: DataFrame, order_by: Sequence[str] = (), n: int = PREVIEW_ROWS) -> DataFrame:
    """The first `n` rows by key, ready for output. Without a key any `n` rows."""
    rows = df.orderBy(*[ref(k) for k in order_by]) if order_by else df
    return null_safe(rows.limit(n))


_DATE_TEXT = r"\d{4}-\d{2}-\d{2}"
_NUMBER_TEXT = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?Infinity|0[xX][0-9a-fA-F]+|)\s*$"


def infer_column_kinds(df: DataFrame, order_by: Sequence[str] = (), n: int = KIND_ROWS) -> DataFrame:
    """(column, kind) guessed from the first rows: numeric, datetime, categorical or unknown."""
    sample = preview(df, order_by, n)
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    logical = {f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)}
    cells = [
        sql.struct(
            {
                "column": sql.text(c),
                "text": f"CAST({sql.quoted(c)} AS STRING)",
                "number": str(c in numeric).upper(),
                "flag": str(c in logical).upper(),
            }
        )
        for c in df.columns
    ]
    number_like = f"number OR (NOT flag AND text RLIKE {sql.text(_NUMBER_TEXT)})"
    dated = f"text RLIKE {sql.text(_DATE_TEXT)}"
    return (
        sample.selectExpr(sql.rows(cells))
        .groupBy("column")
        .agg(
            F.expr(
                "CASE WHEN count(text) = 0 THEN 'unknown' "
                f"WHEN bool_and(CASE WHEN text IS NOT NULL THEN {number_like} END) THEN 'numeric' "
                f"WHEN bool_or({dated}) THEN 'datetime' ELSE 'categorical' END"
            ).alias("kind")
        )
    )
