"""JSON documents and JSON Lines, flattened to plain columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import ref
from ..functions.nested import flatten
from ..operators.tidy import per_column
from .json_blocks import DOCUMENT, ITEM, ROOT_ERROR, stage_json


def _roots(spark: SparkSession, path) -> DataFrame:
    """(file, mark, keys): the first character of each document and, of an object, its keys as written."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("__file"), "value")
    mark = F.regexp_extract("value", r"^\s*(\S)", 1)
    keys = F.when(mark == "{", F.json_object_keys("value"))
    return text.select("__file", mark.alias("__mark"), keys.alias("__keys"))


def _staged_rows(spark: SparkSession, folders: dict[str, str], schema: T.StructType) -> DataFrame:
    """The columns of staged documents, and the keys of those whose root is an object."""
    text = spark.read.text(folders[DOCUMENT])
    rows = text.select(F.from_json("value", schema).alias("row"), F.json_object_keys("value").alias("__keys"))
    rows = rows.select("row.*", "__keys")
    if ITEM in folders:
        items = spark.read.schema(schema).json(folders[ITEM])
        rows = rows.unionByName(items.withColumn("__keys", F.lit(None).cast("array<string>")))
    return rows


def read_json(spark: SparkSession, path: str | Sequence[str], staged: bool = False) -> DataFrame:
    """A root array gives its items; a root object its first list, else itself as one row.

    Every document decides for itself, so a folder may mix them; columns that a document lacks are null. One task
    reads a document, unless they are `staged`: then large ones are cut into blocks, see `stage_json`.
    """
    if staged:
        folders = stage_json(spark, path)
        if not folders:
            return spark.createDataFrame([], T.StructType([]))
        marks = {"{" if kind == DOCUMENT else "[" for kind in folders}
        raw = spark.read.json(list(folders.values()))
    else:
        roots = _roots(spark, path)
        marks = {r["__mark"] for r in roots.select("__mark").distinct().limit(3).collect()}
        if not marks or not marks <= {"[", "{"}:
            raise ValueError(ROOT_ERROR)
        raw = spark.read.json(path, multiLine=True)
    lists = [f.name for f in raw.schema if isinstance(f.dataType, T.ArrayType)]
    if "{" not in marks or not lists:
        return flatten(raw)
    names = raw.columns
    held = F.array_compact(F.array(*[F.when(ref(c).isNotNull(), F.lit(c)) for c in lists]))
    first = F.get(F.filter("__keys", lambda k: F.array_contains("__held", k)), F.lit(0))
    if staged:
        rows = _staged_rows(spark, folders, raw.schema)
    else:
        rows = raw.withColumn("__file", F.col("_metadata.file_path")).join(roots, "__file")
    rows = rows.withColumn("__held", held).withColumn("__list", first)
    used = {r["__list"] for r in rows.select("__list").distinct().collect()}  # names of list columns
    parts = []
    for name in [c for c in lists if c in used]:
        items = rows.where(F.col("__list") == name).select(F.explode(ref(name)).alias("item"))
        if not isinstance(items.schema["item"].dataType, T.StructType):
            raise ValueError(f"items of {name!r} must be objects")
        parts.append(items.select("item.*"))
    if None in used:
        gone = used if marks == {"{"} else set()
        parts.append(rows.where("__list IS NULL").select(*[ref(c) for c in names if c not in gone]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return flatten(out)


def read_jsonl(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One object per line, blank lines skipped; columns without any value are dropped."""
    flat = flatten(spark.read.json(path))
    filled = per_column(flat, flat.columns, lambda c, x: {"n": f"count({x})"}, block=256).where("n > 0")
    kept = {r["column"] for r in filled.collect()}
    return flat.select(*[ref(c) for c in flat.columns if c in kept])
