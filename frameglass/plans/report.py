"""The full profile of a table: tidy sections, quality score and the nested report."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from threading import Lock
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import categorical_columns, normalise, numeric_columns
from ..functions.numbers import shape_hint
from ..operators import quality
from ..operators.association import MAX_CATEGORIES, cramers_v_pairs, pearson_pairs, top_pairs
from ..operators.categorical import categorical_profile, top_values
from ..operators.distribution import TEST_ROWS, histogram, normality, outlier_preview
from ..operators.duplicates import duplicate_rows
from ..operators.numeric import fit_fences, numeric_profile
from ..operators.schema import column_types, logical_size, null_counts, table_shape
from ..operators.temporal import datetime_profile
from ..operators.first_seen import first_values
from ..operators.value_counts import n_unique
from ..operators.value_index import ValueIndex

THREADS = 4

_EMPTY = {
    "numeric": "column string, n bigint, mean double, median double, std double, min double, max double, "
    "p25 double, p75 double, skewness double, kurtosis double, zeros_pct double, "
    "outlier_count bigint, outlier_pct double",
    "categorical": "column string, n bigint, cardinality bigint, mode string, entropy double, rare_pct double",
    "top_values": "column string, rank int, value string, cnt bigint, pct double",
    "normality": "column string, n bigint, tested bigint, method string, w double, p_value double, is_normal boolean",
    "histogram": "column string, bin int, lo double, hi double, cnt bigint",
}


def settle(df: DataFrame) -> DataFrame:
    """A section table computed once and kept as local rows.

    Only for section tables: their size follows the number of columns (or of column
    pairs) of the profiled table, never its rows.
    """
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@dataclass(frozen=True)
class Profile:
    """Tidy section tables, each small and settled."""

    source: str
    sections: Mapping[str, DataFrame]
    order_by: tuple[str, ...]

    def __getitem__(self, name: str) -> DataFrame:
        return self.sections[name]

    def tagged(self, name: str) -> DataFrame:
        """A section with its table name, ready to be united with other profiles."""
        return self[name].withColumn("table", F.lit(self.source))

    def to_dict(self) -> dict[str, Any]:
        return render(self)


def profile(
    df: DataFrame,
    source: str = "unknown",
    order_by: Sequence[str] = (),
    cache: bool = False,
    normality_key: Sequence[str] | None = None,
    test_rows: int = TEST_ROWS,
    max_categories: int = MAX_CATEGORIES,
    approximate_unique: bool = False,
) -> Profile:
    """Profile every column of a table.

    The table is read about ten times, each time with only the columns a section
    needs. `cache=True` keeps it in memory and on disk of the executors instead,
    which pays off for text sources that fit. `order_by` names a key that defines
    row order; the first-values and outlier-preview sections need it. `test_rows` bounds the sample of the
    normality test, `max_categories` the columns that take part in Cramér's V, and `approximate_unique` counts
    distinct values by a sketch.
    """
    spark, flat = df.sparkSession, normalise(df)
    if cache:
        flat = flat.persist()
    try:
        return _profile(spark, flat, source, tuple(order_by), normality_key, test_rows, max_categories, approximate_unique)
    finally:
        if cache:
            flat.unpersist()


class _Once:
    """A result that several threads ask for and the first one computes."""

    def __init__(self, build: Callable[[], Any]) -> None:
        self._build, self._lock, self._found = build, Lock(), []

    def __call__(self) -> Any:
        with self._lock:
            if not self._found:
                self._found.append(self._build())
            return self._found[0]


def _side_by_side(spark: SparkSession, sections: Mapping[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Settle independent sections from a few threads, so that their jobs fill the cluster together."""
    with ThreadPoolExecutor(THREADS) as pool:
        run = inheritable_thread_target(spark)(lambda build: settle(build()))
        started = {name: pool.submit(run, build) for name, build in sections.items()}
        return {name: future.result() for name, future in started.items()}


def _profile(spark, flat, source, order_by, normality_key, test_rows, max_categories, approximate_unique) -> Profile:
    numbers, texts = numeric_columns(flat), categorical_columns(flat)
    key = order_by if normality_key is None else normality_key
    or_empty = lambda name, cols, build: build if cols else lambda: spark.createDataFrame([], _EMPTY[name])
    index = ValueIndex(flat, order_by=order_by)
    # A sketch of distinct values is asked for where they are too many to move, so quartiles come from brackets then.
    fences = _Once(lambda: (fit_fences(flat, numbers) if approximate_unique else index.fences(numbers)) if numbers else {})
    values = lambda: None if approximate_unique else index.numbers(numbers)
    # The long sections go first.
    first = {
        "numeric": or_empty("numeric", numbers, lambda: numeric_profile(flat, numbers, fences=fences())),
        "datetime": lambda: datetime_profile(flat),
        "top_values": or_empty("top_values", texts, lambda: top_values(flat, texts, order_by=order_by, counts=index.counts("string"))),
        "duplicates": lambda: duplicate_rows(flat),
        "normality": or_empty("normality", numbers, lambda: normality(flat, numbers, key=key, test_rows=test_rows, values=values())),
        "cramers_v": lambda: cramers_v_pairs(flat, texts, max_categories),
        "unique": lambda: n_unique(flat, flat.columns, True) if approximate_unique else index.n_unique(flat.columns),
        "categorical": or_empty("categorical", texts, lambda: categorical_profile(flat, texts, counts=index.counts("string"))),
        "pearson": lambda: pearson_pairs(flat, numbers),
        "types": lambda: column_types(flat),
        "missing": lambda: null_counts(flat),
        "size": lambda: logical_size(flat),
        "shape": lambda: table_shape(flat),
    }
    if order_by:
        first["first_values"] = lambda: first_values(flat, flat.columns, order_by)
    s = _side_by_side(spark, first)
    ranges = {r["column"]: (r["min"], r["max"]) if r["n"] else None for r in s["numeric"].collect()}
    second = {
        "histogram": or_empty("histogram", numbers, lambda: histogram(flat, numbers, ranges=ranges)),
        "top_pairs": lambda: top_pairs(s["pearson"], s["cramers_v"]),
        "distributions": lambda: _distributions(s["numeric"], s["normality"], fences()),
        "quality": lambda: _scores(s),
        "flags": lambda: quality.quality_flags(s["missing"], s["duplicates"], s["datetime"]),
    }
    if order_by and numbers:
        second["outlier_preview"] = lambda: outlier_preview(flat, order_by, numbers, fences=fences())
    return Profile(source, {**s, **_side_by_side(spark, second)}, order_by)


def _distributions(numeric: DataFrame, tests: DataFrame, fences) -> DataFrame:
    limits = numeric.sparkSession.createDataFrame(
        [(c, f.lower, f.upper) for c, f in fences.items() if f],
        "column string, lower_fence double, upper_fence double",
    )
    return (
        numeric.where("n > 0")
        .selectExpr("column", "n", f"{shape_hint('skewness')} AS shape", "outlier_count", "outlier_pct")
        .join(tests.select("column", "method", "p_value", "is_normal"), "column", "left")
        .join(limits, "column")
    )


def _scores(s: Mapping[str, DataFrame]) -> DataFrame:
    """The four sub-scores from settled sections, without another pass over the table."""
    n_rows = s["shape"].first()["n_rows"] or 1
    n_cols = s["shape"].first()["n_cols"] or 1
    nulls = s["missing"].agg(F.coalesce(F.sum("null_count"), F.lit(0))).first()[0]
    dups = s["duplicates"].first()["duplicate_rows"]
    outliers = [r["outlier_count"] for r in s["numeric"].collect() if r["n"]]
    rates = sum(outliers) / n_rows / len(outliers) if outliers else 0.0
    on_time = quality.timeliness(s["datetime"]).first()[0]
    row = (1 - nulls / (n_rows * n_cols), 1 - dups / n_rows, 1 - rates, on_time)
    one = s["shape"].sparkSession.createDataFrame(
        [tuple(map(float, row))],
        "completeness double, uniqueness double, consistency double, timeliness double",
    )
    return quality.overall(one)


def _clean(value: Any, digits: int | None = None) -> Any:
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return None
        return round(value, digits) if digits is not None else value
    if isinstance(value, datetime):
        return value.isoformat()
    return value


def _typed(text: str | None, dtype: T.DataType | str) -> Any:
    if text is None:
        return None
    if "int" in dtype:
        return int(text)
    if dtype.startswith("float"):
        return float(text)
    return text == "true" if dtype == "bool" else text


def render(p: Profile) -> dict[str, Any]:
    """The nested report, rounded for reading, from the settled sections."""
    rows = {name: table.collect() for name, table in p.sections.items()}
    by = lambda name: {r["column"]: r for r in rows[name]}
    unique, missing = by("unique"), by("missing")
    types = sorted(rows["types"], key=lambda r: r["ordinal"])
    place = {r["column"]: r["ordinal"] for r in types}
    ordered = lambda name: sorted(rows[name], key=lambda r: place[r["column"]])
    firsts: dict[str, list] = {}
    for r in sorted(rows.get("first_values", ()), key=lambda r: r["rank"]):
        firsts.setdefault(r["column"], []).append(r["value"])
    tops: dict[str, list] = {}
    for r in sorted(rows["top_values"], key=lambda r: r["rank"]):
        tops.setdefault(r["column"], []).append(
            {"value": r["value"], "count": r["cnt"], "pct": _clean(r["pct"], 2)}
        )
    bins: dict[str, list] = {}
    for r in sorted(rows["histogram"], key=lambda r: r["bin"]):
        label = f"[{round(r['lo'], 2)},{round(r['hi'], 2)})"
        bins.setdefault(r["column"], []).append({"range": label, "count": r["cnt"]})
    previews: dict[str, list] = {}
    for r in rows.get("outlier_preview", ()):
        previews.setdefault(r["column"], []).append([_clean(r[k]) for k in p.order_by])
    pairs = lambda name: {
        f"{r['col_a']}__{r['col_b']}": _clean(r["value"], 4) for r in sorted(rows[name], key=lambda r: r["pos"])
    }
    shape, duplicates, score = rows["shape"][0], rows["duplicates"][0], rows["quality"][0]
    report = {
        "meta": {"source_file": p.source, "generated_at": datetime.now(timezone.utc).isoformat()},
        "schema": {
            "n_rows": shape["n_rows"],
            "n_cols": shape["n_cols"],
            "memory_mb": _clean(rows["size"][0]["logical_mb"], 2),
            "columns": [
                {
                    "name": r["column"],
                    "dtype": r["dtype"],
                    "inferred_type": r["inferred_type"],
                    "n_nulls": missing[r["column"]]["null_count"] if r["column"] in missing else 0,
                    "n_unique": unique[r["column"]]["n_unique"],
                    "first_10_unique_values": [_typed(v, r["dtype"]) for v in firsts.get(r["column"], [])],
                }
                for r in types
            ],
        },
        "missing_and_duplicates": {
            "duplicate_rows": duplicates["duplicate_rows"],
            "duplicate_pct": _clean(duplicates["duplicate_pct"], 2),
            "columns": {
                r["column"]: {"null_count": r["null_count"], "null_pct": _clean(r["null_pct"], 2)}
                for r in ordered("missing")
            },
        },
        "univariate": {
            "numeric": {
                r["column"]: {
                    **{m: _clean(r[m]) for m in ("mean", "median", "std", "min", "max", "p25", "p75", "skewness", "kurtosis")},
                    "zeros_pct": _clean(r["zeros_pct"], 2),
                    "outlier_count": r["outlier_count"],
                    "outlier_pct": _clean(r["outlier_pct"], 2),
                }
                for r in ordered("numeric")
            },
            "categorical": {
                r["column"]: {
                    "cardinality": r["cardinality"],
                    "top_values": tops.get(r["column"], []),
                    "entropy": _clean(r["entropy"]),
                    "mode": r["mode"],
                    "rare_pct": _clean(r["rare_pct"], 2),
                }
                for r in ordered("categorical")
            },
        },
        "datetime": {
            r["column"]: {k: v for k, v in r.asDict().items() if k != "column"} for r in ordered("datetime")
        },
        "correlations": {
            "pearson": pairs("pearson"),
            "cramers_v": pairs("cramers_v"),
            "top_corr_pairs": [{**r.asDict(), "value": _clean(r["value"], 4)} for r in rows["top_pairs"]],
        },
        "distributions": {
            r["column"]: {
                "normality_test": {
                    "method": r["method"] or "shapiro",
                    "p_value": _clean(r["p_value"], 5),
                    "is_normal": r["is_normal"],
                },
                "dist_type_hint": r["shape"],
                "histogram_bins": bins.get(r["column"], []),
                "outlier_summary": {
                    "count": r["outlier_count"],
                    "pct": _clean(r["outlier_pct"], 2),
                    "lower_fence": _clean(r["lower_fence"], 4),
                    "upper_fence": _clean(r["upper_fence"], 4),
                    "preview_keys": previews.get(r["column"], []),
                },
            }
            for r in ordered("distributions")
        },
        "data_quality_score": {
            **{k: _clean(score[k], 4) for k in ("completeness", "consistency", "uniqueness", "timeliness", "overall_score")},
            "flags": [r["flag"] for r in rows["flags"]],
        },
    }
    return {"eda_report": report}


def sections_long(spark: SparkSession, profiles: Sequence[Profile]) -> DataFrame:
    """(table, section, column, metric, value): all per-column sections in one tidy text table."""
    parts = []
    for p in profiles:
        for name, table in p.sections.items():
            fields = [c for c in table.columns if c != "column"]
            column = F.col("column") if "column" in table.columns else F.lit(None).cast("string")
            cells = [F.struct(F.lit(f).alias("metric"), F.col(f).cast("string").alias("value")) for f in fields]
            parts.append(
                table.select(
                    F.lit(p.source).alias("table"), F.lit(name).alias("section"), column.alias("column"),
                    F.inline(F.array(*cells)),
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
