"""Write cleaned tables and profile reports."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nested import flatten
from .reader import preview

CLEAN_PREVIEW_ROWS = 50


def clean_name(source: str) -> str:
    """`{stem}_preprocessed.csv` for a source name."""
    return f"{PurePosixPath(source).stem}_preprocessed.csv"


def write_clean(df: DataFrame, folder: str, source: str, fmt: str = "csv") -> str:
    """Write a table below `folder` under its cleaned name; returns the path.

    Every task writes its own part file; the cleaned table never passes one task.
    """
    path = f"{folder.rstrip('/')}/{clean_name(source)}"
    if fmt == "parquet":
        path = path.removesuffix(".csv") + ".parquet"
        df.write.mode("overwrite").parquet(path)
        return path
    flatten(df).write.mode("overwrite").options(
        header=True,
        escape='"',
        emptyValue="",
        timestampFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS]",
        timestampNTZFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    ).csv(path)
    return path


def clean_preview(df: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    return preview(df, order_by, CLEAN_PREVIEW_ROWS)


def section_json(section: str, table: DataFrame) -> DataFrame:
    """(section, body): every row of a tidy section table as JSON text."""
    body = F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"})
    return table.select(F.lit(section).alias("section"), body.alias("body"))


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """All tidy sections as JSON lines, one folder per section."""
    for name, table in sections.items():
        section_json(name, table).write.mode("overwrite").partitionBy("section").option(
            "compression", "none"
        ).text(f"{path.rstrip('/')}/{name}")


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """The nested report as one indented JSON text; its size follows the column count."""
    text = json.dumps(report, indent=2, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
