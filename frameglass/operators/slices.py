"""Profiles per slice of a table: the sections of a profile for every group of rows.

Nothing of a slice reaches the driver, so there may be any number of them, and one may hold most rows. Order
statistics come from an index of values: (slice, column, value, count) in sorted runs, with the number of rows before
each value, so a quantile is the value whose rows span its rank, and outliers are counted from the counts of values.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sql
from ..functions.kinds import blocks, categorical_columns, normalise, numeric_columns, require_columns
from ..functions.normality import shapiro_wilk
from ..functions.numbers import finite, finite_view, sample_kurtosis, sample_skewness, share_pct
from ..session import scratch_path
from .categorical import ENTROPY_SHIFT, RARE_SHARE
from .distribution import ALPHA, TEST_ROWS
from .numeric import FENCE_REACH
from .sampling import sample_key
from .tidy import AGGREGATES_PER_PASS, union_all

SLICE = "__slice"
GROUP = [SLICE, "column"]
#: Leading hexadecimal digits of draws that are counted: a slice passes on about one in 16 ** DRAW_DIGITS of its rows beside the sample.
DRAW_DIGITS = 3
QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _slice(by: Sequence[str]) -> str:
    return f"struct({', '.join(map(sql.quoted, by))}) AS {SLICE}"


def _named(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The slice's own columns in front of the others."""
    keys = [F.col(f"{SLICE}.{sql.quoted(c)}").alias(c) for c in by]
    return df.select(*keys, *[c for c in df.columns if c != SLICE])


def _cells(df: DataFrame, by: Sequence[str], cols: Sequence[str], value) -> DataFrame:
    cells = [sql.struct({"column": sql.text(c), "value": value(sql.quoted(c))}) for c in cols]
    return df.selectExpr(_slice(by), sql.rows(cells)).where("value IS NOT NULL")


def value_counts_by(df: DataFrame, by: Sequence[str], cols: Sequence[str], value=finite) -> DataFrame:
    """(slice, column, value, cnt) of non-null values, with one shuffle: repeats collapse in their task."""
    return _cells(df, by, cols, value).groupBy(*GROUP, "value").agg(F.count(F.lit(1)).alias("cnt"))


def value_index(df: DataFrame, by: Sequence[str], cols: Sequence[str], value=finite) -> DataFrame:
    """(slice, column, run, value, cnt, before, n): values in order, with the rows before each and of all in its slice and column.

    Values are dealt to sorted runs by range, whatever slice they are of, so a slice of any size is spread over many runs. Rows
    before a value are those of earlier runs, of which there are few, and those inside its run.
    """
    counts = value_counts_by(df, by, cols, value)
    runs = _written(counts.repartitionByRange(*GROUP, "value").withColumn("run", F.spark_partition_id()), "value-runs")
    sums = runs.groupBy(*GROUP, "run").agg(F.sum("cnt").alias("rows"))
    group = Window.partitionBy(*GROUP)
    earlier = F.sum("rows").over(group.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*GROUP, "run", F.coalesce(earlier, F.lit(0)).alias("start"), F.sum("rows").over(group).alias("n"))
    inside = F.sum("cnt").over(Window.partitionBy(*GROUP, "run").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    placed = runs.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, [*GROUP, "run"])
    index = placed.select(*GROUP, "run", "value", "cnt", (F.col("start") + F.col("inside")).alias("before"), "n")
    return _written(index, "value-index")


def order_statistics(index: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """(slice, column, n, …): exact quantiles, interpolated between the two values next to their rank."""
    picked, shown = [], []
    for name, q in quantiles.items():
        if not 0 <= q <= 1:
            raise ValueError(f"{name}: a quantile is between 0 and 1")
        for end, rank in (("lo", "floor"), ("hi", "ceil")):
            at = f"{rank}((n - 1) * {float(q)!r}D)"
            picked.append(F.expr(f"max(CASE WHEN before <= {at} AND {at} < before + cnt THEN value END)").alias(f"{name}_{end}"))
        part = f"((n - 1) * {float(q)!r}D - floor((n - 1) * {float(q)!r}D))"
        shown.append(f"{sql.quoted(name + '_lo')} + {part} * ({sql.quoted(name + '_hi')} - {sql.quoted(name + '_lo')}) AS {sql.quoted(name)}")
    found = index.groupBy(*GROUP).agg(F.max("n").alias("n"), *picked)
    return found.selectExpr(*GROUP, "n", *shown)


def _fenced(index: DataFrame, quartiles: DataFrame) -> DataFrame:
    """(slice, column, outlier_count, outlier_pct, lower_fence, upper_fence)."""
    reach = f"{FENCE_REACH}D * (p75 - p25)"
    fences = quartiles.selectExpr(*GROUP, "n", f"p25 - {reach} AS lower_fence", f"p75 + {reach} AS upper_fence")
    # Fences are looked up by run, so a hot slice stays spread.
    by_run = index.select(*GROUP, "run").distinct().join(fences.drop("n"), GROUP)
    outside = F.expr("sum(CASE WHEN value < lower_fence OR value > upper_fence THEN cnt ELSE 0 END)")
    counts = index.join(by_run, [*GROUP, "run"]).groupBy(*GROUP).agg(outside.alias("outlier_count"))
    return fences.join(counts, GROUP).selectExpr(
        *GROUP, "n", "outlier_count", f"{share_pct('outlier_count', 'n')} AS outlier_pct", "lower_fence", "upper_fence"
    )


def _wide(df: DataFrame, by: Sequence[str], cols: Sequence[str], metrics) -> DataFrame:
    """Aggregates of each slice and column: one map-side combined pass per block of columns."""
    parts = []
    for chunk in blocks(cols, max(1, AGGREGATES_PER_PASS // len(metrics("x")))):
        rows = [F.expr(sql.struct({"column": sql.text(c), **metrics(sql.quoted(c))})).alias(f"row_{i}") for i, c in enumerate(chunk)]
        keyed = df.selectExpr(_slice(by), *map(sql.quoted, chunk))
        parts.append(keyed.groupBy(SLICE).agg(*rows).selectExpr(SLICE, sql.rows([f"row_{i}" for i in range(len(chunk))])))
    return union_all(parts)


def _moments(x: str) -> dict[str, str]:
    return {
        "n": f"count({x})", "mean": f"avg({x})", "std": f"stddev_samp({x})", "min": f"min({x})", "max": f"max({x})",
        "skewness": sample_skewness(x), "kurtosis": sample_kurtosis(x),
        "zeros_pct": f"try_divide(count_if({x} = 0) * 100.0D, count({x}))",
    }


def slice_missing(df: DataFrame, by: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """(slice columns, column, n_rows, null_count, null_pct); columns without nulls in a slice are left out of it."""
    flat = normalise(df)
    cols = _others(flat, by, flat.columns) if cols is None else list(cols)
    counts = _wide(flat, by, cols, lambda x: {
        "n_rows": "count(1)", "null_count": f"count_if({x} IS NULL)", "null_pct": share_pct(f"count_if({x} IS NULL)", "count(1)")})
    return _named(counts.where("null_count > 0"), by)


def slice_numeric(df: DataFrame, by: Sequence[str], cols: Sequence[str] | None = None, index: DataFrame | None = None) -> DataFrame:
    """(slice columns, column, n, mean, …): the numeric section of every slice; null, NaN and infinite values are left out.

    A slice without usable values of a column has a row with n = 0 for it.
    """
    cols = _others(df, by, numeric_columns(df)) if cols is None else list(cols)
    index = value_index(df, by, cols) if index is None else index
    quartiles = order_statistics(index, QUARTILES)
    fenced = _fenced(index, quartiles).select(*GROUP, "outlier_count", "outlier_pct")
    moments = _wide(_usable(df, by, cols), by, cols, _moments)
    both = moments.join(quartiles.drop("n"), GROUP, "left").join(fenced, GROUP, "left")
    filled = both.withColumns({"outlier_count": F.coalesce("outlier_count", F.lit(0)), "outlier_pct": F.coalesce("outlier_pct", F.lit(0.0))})
    return _named(filled, by)


def slice_outliers(df: DataFrame, by: Sequence[str], cols: Sequence[str] | None = None, index: DataFrame | None = None) -> DataFrame:
    """(slice columns, column, n, outlier_count, outlier_pct, lower_fence, upper_fence) by each slice's own fences."""
    cols = _others(df, by, numeric_columns(df)) if cols is None else list(cols)
    index = value_index(df, by, cols) if index is None else index
    return _named(_fenced(index, order_statistics(index, QUARTILES)), by)


def slice_categorical(df: DataFrame, by: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """(slice columns, column, n, cardinality, mode, entropy, rare_pct) of string columns that hold a value in the slice."""
    cols = _others(df, by, categorical_columns(df)) if cols is None else list(cols)
    counts = _written(value_counts_by(df, by, cols, value=lambda x: x), "slice-counts")
    totals = counts.groupBy(*GROUP).agg(
        F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("cardinality"), F.min(F.struct(-F.col("cnt"), "value")).alias("first")
    )
    p = F.col("cnt") / F.col("n")
    shares = counts.join(totals.select(*GROUP, "n"), GROUP).groupBy(*GROUP).agg(
        (-F.sum(p * F.log2(p + F.lit(ENTROPY_SHIFT)))).alias("entropy"),
        (F.coalesce(F.sum(F.when(p < RARE_SHARE, p)), F.lit(0.0)) * 100).alias("rare_pct"),
    )
    return _named(totals.join(shares, GROUP).select(*GROUP, "n", "cardinality", F.col("first.value").alias("mode"), "entropy", "rare_pct"), by)


def smallest_draws(df: DataFrame, by: Sequence[str], cols: Sequence[str], key: Sequence[str], k: int = TEST_ROWS) -> DataFrame:
    """(slice, column, x, place): of each slice and column the `k` usable values whose rows draw the smallest digests of `key`.

    A first scan counts the cells of each slice, column and leading part of the draws, with repeats summed in their tasks. From these
    counts follows which parts hold the `k` smallest, and only their cells are moved and put in order. Equal draws are
    ordered by their value, so the sample is the same under any layout of the rows. The parts of a key that names
    few rows are as large as those of its rows.
    """
    require_columns(df, [*by, *key])
    cells = [sql.struct({"column": sql.text(c), "x": finite(sql.quoted(c))}) for c in cols]
    long = df.withColumn("__draw", sample_key(key)).selectExpr(_slice(by), "__draw", sql.rows(cells)).where("x IS NOT NULL")
    long = long.withColumn("part", F.substring("__draw", 1, DRAW_DIGITS))
    counts = long.groupBy(*GROUP, "part").agg(F.count(F.lit(1)).alias("cnt"))
    before = F.sum("cnt").over(Window.partitionBy(*GROUP).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Written, so that their size is known when the join is planned: few parts are sent to all tasks, many are dealt out.
    parts = _written(counts.select(*GROUP, "part", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < k).drop("before"), "draw-parts")
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy("__draw", "x")).alias("place")
    near = long.join(parts, [*GROUP, "part"], "left_semi")
    return near.select(*GROUP, "x", place).where(F.col("place") <= k)


def slice_normality(
    df: DataFrame, by: Sequence[str], key: Sequence[str], cols: Sequence[str] | None = None, test_rows: int = TEST_ROWS
) -> DataFrame:
    """(slice columns, column, tested, method, w, p_value, is_normal): the normality test of every slice, side by side.

    Above `test_rows` values the rows with the smallest draws are tested. Fewer than three values give nulls.
    """
    cols = _others(df, by, numeric_columns(df)) if cols is None else list(cols)
    drawn = _written(smallest_draws(df, by, cols, key, test_rows), "drawn")  # used twice

    def test(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(rows["x"].to_numpy())
        return pd.DataFrame({"id": [group[0]], "tested": [len(rows)], "w": pd.array([w], "Float64"), "p_value": pd.array([p], "Float64")})

    # Python sees a digest in place of the slice, whose columns may be of any type.
    digest = F.sha2(F.to_json(F.struct(*GROUP), {"ignoreNullFields": "false"}), 256).alias("id")
    tested = drawn.select(digest, "x").groupBy("id").applyInPandas(test, "id string, tested long, w double, p_value double")
    named = drawn.where("place = 1").select(*GROUP, digest).join(tested, "id")
    return _named(named.select(
        *GROUP, "tested", F.lit("shapiro").alias("method"), "w", "p_value", (F.col("p_value") > ALPHA).alias("is_normal")), by)


def _others(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> list[str]:
    require_columns(df, by)
    if not by:
        raise ValueError("name at least one column to slice by")
    if "column" in by:
        raise ValueError("rename the column that is called `column`: sections have one of that name")
    return [c for c in cols if c not in set(by)]


def _usable(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return finite_view(df, cols, keep=by)


def profile_slices(df: DataFrame, by: Sequence[str], key: Sequence[str] = (), test_rows: int = TEST_ROWS) -> dict[str, DataFrame]:
    """The sections of a profile for every slice of `df` by the columns `by`: missing, numeric, outliers, categorical and, with
    a `key` that names rows, normality. Each is a tidy table that begins with the slice's columns; nulls make a slice of their
    own. A table without columns of a kind has no such section."""
    numbers, texts = _others(df, by, numeric_columns(df)), _others(df, by, categorical_columns(df))
    out = {"missing": slice_missing(df, by)}
    if numbers:
        index = value_index(df, by, numbers)
        out["numeric"] = slice_numeric(df, by, numbers, index)
        out["outliers"] = slice_outliers(df, by, numbers, index)
        if key:
            out["normality"] = slice_normality(df, by, key, numbers, test_rows)
    if texts:
        out["categorical"] = slice_categorical(df, by, texts)
    return out
