"""Histograms, outlier summaries and the normality test of numeric columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normality as normality_module
from ..functions import sql
from ..functions.kinds import numeric_columns
from ..functions.normality import shapiro_wilk
from ..functions.numbers import finite, finite_view, sample_skewness, shape_hint, share_pct
from ..functions.sql import number
from ..session import scratch_path
from .numeric import Fence, fit_fences
from .sampling import sample_key
from .tidy import per_column, union_all

# The test travels with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(normality_module)

BINS = 10
TEST_ROWS = 5_000
ALPHA = 0.05
DRAW = "__fg_draw"
PREVIEW = 10


def shape_hints(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, shape) from the bias-adjusted skewness."""
    cols = numeric_columns(df) if cols is None else list(cols)
    view = finite_view(df, cols)
    return per_column(view, cols, lambda c, x: {"skew": sample_skewness(x)}).selectExpr(
        "column", f"{shape_hint('skew')} AS shape"
    )


def value_ranges(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float] | None]:
    rows = per_column(
        finite_view(df, cols), cols, lambda c, x: {"lo": f"min({x})", "hi": f"max({x})"}
    ).collect()
    return {r["column"]: None if r["lo"] is None else (r["lo"], r["hi"]) for r in rows}


def bin_edges(lo: float, hi: float, bins: int = BINS) -> list[float]:
    """Equal-width edges; a constant column gets half a unit on either side."""
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    return [lo + i * step for i in range(bins)] + [hi]


def _bin_of(x: str, edges: Sequence[float]) -> str:
    """Index of the last edge at or below x; the top edge belongs to the last bin."""
    cases = " ".join(f"WHEN {x} < {number(e)} THEN {i}" for i, e in enumerate(edges[1:-1]))
    return f"CASE WHEN {x} IS NULL THEN NULL {cases} ELSE {len(edges) - 2} END"


def histogram(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    bins: int = BINS,
    ranges: dict[str, tuple[float, float] | None] | None = None,
) -> DataFrame:
    """(column, bin, lo, hi, cnt) with empty bins; columns without values are left out."""
    cols = numeric_columns(df) if cols is None else list(cols)
    ranges = value_ranges(df, cols) if ranges is None else ranges
    edges = {c: bin_edges(*ranges[c], bins) for c in cols if ranges.get(c)}
    frame = df.sparkSession.createDataFrame(
        [(c, i, e[i], e[i + 1]) for c, e in edges.items() for i in range(bins)],
        "column string, bin int, lo double, hi double",
    )
    if not edges:
        return frame.withColumn("cnt", F.lit(0).cast("bigint"))
    cells = [
        sql.struct({"column": sql.text(c), "bin": _bin_of(sql.quoted(c), e)}) for c, e in edges.items()
    ]
    counts = (
        finite_view(df, list(edges))
        .selectExpr(sql.rows(cells))
        .where("bin IS NOT NULL")
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    # Both sides hold at most `bins` rows per column.
    return frame.join(F.broadcast(counts), ["column", "bin"], "left").select(
        "column", "bin", "lo", "hi", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt")
    )


def outlier_summary(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    fences: dict[str, Fence | None] | None = None,
) -> DataFrame:
    """(column, n, outlier_count, outlier_pct of non-null, lower_fence, upper_fence)."""
    cols = numeric_columns(df) if cols is None else list(cols)
    fences = fit_fences(df, cols) if fences is None else fences
    cols = [c for c in cols if fences[c]]
    if not cols:
        return df.sparkSession.createDataFrame(
            [],
            "column string, n bigint, outlier_count bigint, outlier_pct double, "
            "lower_fence double, upper_fence double",
        )

    def metrics(c: str, x: str) -> dict[str, str]:
        outside = f"count_if({fences[c].outside(x)})"
        return {
            "n": f"count({x})",
            "outlier_count": outside,
            "outlier_pct": share_pct(outside, f"count({x})"),
            "lower_fence": f"max({number(fences[c].lower)})",
            "upper_fence": f"max({number(fences[c].upper)})",
        }

    return per_column(finite_view(df, cols), cols, metrics)


def outlier_preview(
    df: DataFrame,
    order_by: Sequence[str],
    cols: Sequence[str] | None = None,
    n: int = PREVIEW,
    fences: dict[str, Fence | None] | None = None,
) -> DataFrame:
    """(column, order keys…, value): the first outliers in row order.

    Each column is a filtered top-n: `n` rows per task reach the merge.
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    fences = fit_fences(df, cols) if fences is None else fences
    keys = [sql.quoted(k) for k in order_by]
    parts = []
    for c in cols:
        if fences[c]:
            x = finite(sql.quoted(c))
            hits = df.where(fences[c].outside(x)).orderBy(*keys).limit(n)
            parts.append(hits.selectExpr(f"{sql.text(c)} AS column", *keys, f"{x} AS value"))
    if not parts:
        return df.limit(0).selectExpr("'' AS column", *keys, "0.0D AS value")
    return union_all(parts)


def normality(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    key: Sequence[str] = (),
    test_rows: int = TEST_ROWS,
    values: DataFrame | None = None,
) -> DataFrame:
    """(column, n, tested, method, w, p_value, is_normal) by Shapiro-Wilk.

    Columns are tested in parallel. Above `test_rows` values a column is sampled,
    as the test is only defined for small samples: each row draws a number, a bound on it keeps
    a few more rows than needed on the map side, and the rows with the smallest draws
    are tested, so a group holds `test_rows` values however large the table is. With `key` (columns that
    identify a row) the sample is the same on every run. If the key turns out not to identify
    the rows it drew, rows draw by their place in the partitions instead. Values never decide what is drawn.
    Counted values (column, value, cnt), where they are at hand, give the sizes.
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    if values is None:
        counts = per_column(finite_view(df, cols), cols, lambda c, x: {"n": f"count({x})"})
    else:
        counts = values.groupBy("column").agg(F.sum("cnt").alias("n"))
    sizes = dict.fromkeys(cols, 0) | {r["column"]: r["n"] for r in counts.collect()}
    by_place = F.md5(F.concat_ws("|", F.lit("42"), F.monotonically_increasing_id().cast("string")))
    draw = sample_key(key) if key else by_place
    drawn = None
    if all(n <= test_rows for n in sizes.values()):
        draw = F.lit("")
    elif key:
        path = scratch_path(df.sparkSession, "normality-draws")  # digests of all rows are made once
        _drawn(df, cols, sizes, draw, test_rows).write.parquet(path)
        drawn = df.sparkSession.read.parquet(path)
        found = drawn.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(DRAW).alias("draws")).collect()
        enough = {r["column"] for r in found if r["rows"] == r["draws"] >= min(sizes[r["column"]], test_rows)}
        if any(n > test_rows and c not in enough for c, n in sizes.items()):
            draw, drawn = by_place, None
    if drawn is None:
        drawn = _drawn(df, cols, sizes, draw, test_rows)
    place = F.row_number().over(Window.partitionBy("column").orderBy(DRAW))
    long = drawn.withColumn("place", place).where(F.col("place") <= test_rows)

    def test(group: pd.DataFrame) -> pd.DataFrame:
        n = group["n"].iloc[0]
        if len(group) < min(n, test_rows):
            raise ValueError(f"{group['column'].iloc[0]}: {len(group)} of {n} values drawn, {test_rows} wanted")
        w, p = shapiro_wilk(group["x"].to_numpy())
        return pd.DataFrame(
            {
                "column": [group["column"].iloc[0]],
                "n": [n],
                "tested": [len(group)],
                "w": pd.array([w], dtype="Float64"),
                "p_value": pd.array([p], dtype="Float64"),
            }
        )

    tested = long.groupBy("column").applyInPandas(
        test, "column string, n bigint, tested bigint, w double, p_value double"
    )
    return tested.select(
        "column", "n", "tested", F.lit("shapiro").alias("method"), "w", "p_value",
        (F.col("p_value") > ALPHA).alias("is_normal"),
    )


def _drawn(df: DataFrame, cols: Sequence[str], sizes: dict[str, int], draw: Column, test_rows: int) -> DataFrame:
    """(draw, column, x, n): all values of small columns, of others those below a bound of the draw."""
    cells = []
    for c in cols:
        n, x = sizes[c], sql.quoted(c)
        share = (test_rows + 8 * math.sqrt(test_rows)) / n if n > test_rows else 1.0
        if share < 1.0:
            bound = format(int(share * 16**12), "012x")
            x = f"CASE WHEN {DRAW} < '{bound}' THEN {x} END"
        cells.append(sql.struct({"column": sql.text(c), "x": x, "n": f"{n}L"}))
    drawn = finite_view(df.withColumn(DRAW, draw), cols, keep=[DRAW])
    return drawn.selectExpr(DRAW, sql.rows(cells)).where("x IS NOT NULL")
