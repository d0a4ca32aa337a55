"""One written table of (column, value, count), from which cardinality, modes, shares and exact order statistics are looked up.

Each type class is counted once, with one shuffle after repeats have collapsed in their tasks. Numbers are then dealt to
sorted runs by Spark's range partitioning. The rows of a run and before it follow from a sum of each run, so the run that
holds a wanted rank is known and only that run is read again. Nothing but the values found reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from threading import Lock

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sql
from ..functions.kinds import by_class
from ..functions.numbers import finite
from ..session import scratch_path
from .numeric import Fence
from .quantiles import Quantiles
from .tidy import union_all
from .value_counts import value_counts


def _is_number(kind: str) -> bool:
    return kind in ("integer", "floating") or kind.startswith("decimal")


class ValueIndex:
    """Counted values of the columns of a table; each type class is counted when it is first asked for.

    `order_by` makes text values carry the key of their first row. Columns of nested types have no index. Values that are
    null or NaN are left out. An index may be asked from several threads.
    """

    def __init__(self, df: DataFrame, cols: Sequence[str] | None = None, order_by: Sequence[str] = ()) -> None:
        self._df, self._order_by = df, tuple(order_by)
        self.kinds = by_class(df, cols)
        self._locks = {kind: Lock() for kind in self.kinds}
        self._tables: dict[str, DataFrame] = {}

    def counts(self, kind: str) -> DataFrame:
        """(column, value, cnt, run[, first_seen]) of a type class, written; runs of numbers are in order."""
        with self._locks[kind]:
            if kind not in self._tables:
                self._tables[kind] = self._counted(kind)
            return self._tables[kind]

    def _counted(self, kind: str) -> DataFrame:
        counts = value_counts(self._df, self.kinds[kind], self._order_by if kind == "string" else ())
        if _is_number(kind):
            counts = counts.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
        path = scratch_path(self._df.sparkSession, "value-index")
        counts.withColumn("run", F.spark_partition_id()).write.parquet(path)
        return self._df.sparkSession.read.parquet(path)

    def n_unique(self, cols: Sequence[str]) -> DataFrame:
        """(column, n_unique): distinct values, 0 without any, null for columns without an index."""
        spark, wanted = self._df.sparkSession, list(cols)
        kinds = [kind for kind, names in self.kinds.items() if set(names) & set(wanted)]
        counted = {c for kind in kinds for c in self.kinds[kind]}
        names = spark.createDataFrame([(c, 0 if c in counted else None) for c in wanted], "column string, least bigint")
        if not kinds:
            return names.select("column", F.col("least").alias("n_unique"))
        seen = union_all([self.counts(kind).groupBy("column").agg(F.count(F.lit(1)).alias("seen")) for kind in kinds])
        return names.join(seen, "column", "left").select("column", F.coalesce("seen", "least").alias("n_unique"))

    def numbers(self, cols: Sequence[str]) -> DataFrame:
        """(column, run, value, cnt) of finite values as doubles."""
        kinds = [kind for kind, names in self.kinds.items() if set(names) & set(cols)]
        parts = [self.counts(kind).selectExpr("column", "run", f"{finite('value')} AS value", "cnt") for kind in kinds]
        wanted = ", ".join(map(sql.text, cols))
        return union_all(parts).where(f"value IS NOT NULL AND column IN ({wanted})")

    def quantiles(self, wanted: Mapping[str, Sequence[float]]) -> Quantiles:
        """{column: {p: quantile}} of finite values, exact, interpolated between the two values next to the rank."""
        found: Quantiles = {c: dict.fromkeys(ps) for c, ps in wanted.items()}
        asked = [(c, float(p)) for c, ps in wanted.items() for p in ps]
        if any(not 0 <= p <= 1 for _, p in asked):
            raise ValueError("a quantile is between 0 and 1")
        numbers = {c for kind, names in self.kinds.items() if _is_number(kind) for c in names}
        if wrong := sorted(set(wanted) - numbers):
            raise ValueError(f"no numbers are indexed for {wrong}")
        if not asked:
            return found
        spark, values = self._df.sparkSession, self.numbers(list(wanted))
        column = Window.partitionBy("column")  # a row per run
        earlier = F.sum("rows").over(column.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
        runs = values.groupBy("column", "run").agg(F.sum("cnt").alias("rows"))
        runs = runs.select("column", "run", "rows", F.coalesce(earlier, F.lit(0)).alias("start"), F.sum("rows").over(column).alias("n"))
        places = F.broadcast(spark.createDataFrame(asked, "column string, p double"))  # a row per wanted quantile
        ends = F.expr("inline(array(named_struct('end', 'lo', 'rank', floor((n - 1) * p)), named_struct('end', 'hi', 'rank', ceil((n - 1) * p))))")
        hits = runs.join(places, "column").select("column", "p", "run", "rows", "start", "n", ends)
        hits = hits.where("start <= rank AND rank < start + rows").selectExpr("column", "p", "end", "run", "n", "rank - start AS at").collect()
        if not hits:
            return found
        read = sorted({(r["column"], r["run"]) for r in hits})
        named = " OR ".join(f"(column = {sql.text(c)} AND run = {run})" for c, run in read)
        inside = F.sum("cnt").over(Window.partitionBy("column", "run").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        spans = values.where(named).select("column", "run", "value", "cnt", inside.alias("upto"))
        picks = F.broadcast(spark.createDataFrame([(r["column"], r["p"], r["end"], r["run"], r["at"]) for r in hits], "column string, p double, end string, run int, at bigint"))
        picked = spans.join(picks, ["column", "run"]).where("upto - cnt <= at AND at < upto").select("column", "p", "end", "value").collect()
        sizes = {(r["column"], r["p"]): r["n"] for r in hits}
        value = {(r["column"], r["p"], r["end"]): r["value"] for r in picked}
        for (c, p), n in sizes.items():
            low, high = value[c, p, "lo"], value[c, p, "hi"]
            part = (n - 1) * p - int((n - 1) * p)
            found[c][p] = low if low == high else low + (high - low) * part
        return found

    def fences(self, cols: Sequence[str]) -> dict[str, Fence | None]:
        """Quartiles of each column; None without finite values."""
        found = self.quantiles({c: (0.25, 0.5, 0.75) for c in cols})
        return {c: None if q[0.5] is None else Fence(q[0.25], q[0.5], q[0.75]) for c, q in found.items()}
