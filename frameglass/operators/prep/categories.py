"""The sorted distinct values of columns, small or large."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.kinds import ref
from ...session import scratch_path
from ..value_counts import long_values, top_n

# One more than this is still within Spark's default limit for per-task top-n.
LISTED = 999
RUN_ROWS = 1_000_000


@dataclass
class Categories:
    """Either the sorted list of values, or a written (value, code) table and its size."""

    values: list[str] | None = None
    table: DataFrame | None = None
    rows: int | None = None
    bytes: int | None = None

    def __post_init__(self) -> None:
        if self.values is not None:
            self.rows, self.bytes = len(self.values), sum(len(v.encode()) for v in self.values)

    def listed(self, most: int) -> list[str]:
        """All values in sorted order, for uses that make something of each on the driver; raises beyond `most`."""
        if self.rows > most:
            raise ValueError(f"{self.rows} categories, more than {most}")
        if self.table is None:
            return self.values
        return [r["value"] for r in self.table.orderBy("code").collect()]

    def code_table(self, df: DataFrame) -> DataFrame:
        if self.table is not None:
            return self.table
        rows = [(v, i) for i, v in enumerate(self.values)]
        return df.sparkSession.createDataFrame(rows, "value string, code bigint")


def learn_categories(
    df: DataFrame, cols: Sequence[str], listed: int = LISTED
) -> dict[str, Categories]:
    """One distinct shuffle lists up to `listed` values of each column.

    The per-column limit is applied in each task before the shuffle. Only columns
    with more values go on to a distributed ranking.
    """
    values = long_values(df, cols, cast="string").where("value IS NOT NULL").distinct()
    rows = top_n(values, listed + 1, F.col("value").asc()).collect()
    found: dict[str, list[str]] = {c: [] for c in cols}
    for row in sorted(rows, key=lambda r: r["rank"]):
        found[row["column"]].append(row["value"])
    return {c: Categories(values=v) if len(v) <= listed else ranked(df, c) for c, v in found.items()}


def ranked(df: DataFrame, column: str, run_rows: int = RUN_ROWS) -> Categories:
    """All distinct values with their codes by sorted order, without a global sort or a list on the driver.

    Spark cuts the values into sorted runs of some `run_rows` values. Each task numbers its run as it writes it;
    the sizes of the runs before, a row per run, shift these numbers. The plan is the same for any number of
    values. The result is written once, so later uses do not depend on this plan.
    """
    spark = df.sparkSession
    text = ref(column).cast("string")
    distinct, runs, codes = (scratch_path(spark, label) for label in ("values", "runs", "codes"))
    df.select(text.alias("value")).where("value IS NOT NULL").distinct().write.parquet(distinct)
    values = spark.read.parquet(distinct)  # one shuffle; the passes below read the copy
    size = values.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("b")).first()
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the place within its partition
    cut = values.repartitionByRange(max(size["n"] // run_rows, 1), "value").sortWithinPartitions("value")
    cut.select("value", F.spark_partition_id().alias("run"), row.alias("place")).write.parquet(runs)
    placed = spark.read.parquet(runs)
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # over a row per run
    starts = (
        placed.groupBy("run").agg(F.count(F.lit(1)).alias("n")).select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    coded = placed.join(F.broadcast(starts), "run").select("value", (F.col("start") + F.col("place")).alias("code"))
    coded.write.parquet(codes)
    return Categories(table=spark.read.parquet(codes), rows=size["n"], bytes=size["b"])


def ranked_values(df: DataFrame, column: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """(value, code) of all distinct values, as `ranked` finds them."""
    return ranked(df, column, run_rows).table
