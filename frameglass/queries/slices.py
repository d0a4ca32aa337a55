"""Queries over profiles per slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import slices
from .common import LINE_KEY, PLANTED_SQL, Query, planted_lines, rounded, table, union_sql
from .shapiro_sql import shapiro_sql

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_BY, _FLAG = ["l_returnflag", "l_linestatus"], ["l_returnflag"]
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_line"]


def _per_slice(expr: str, cols: list[str], by: list[str], source: str) -> str:
    """Reference SQL: aggregates over `x` for every slice and column; `lo` and `hi` are the slice's fences."""
    keys = ", ".join(by)
    return union_sql([
        f"SELECT {keys}, '{c}' AS \"column\", {expr} FROM (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
        f"(SELECT {keys}, CAST({c} AS DOUBLE) AS x, quantile_cont(CAST({c} AS DOUBLE), 0.25) OVER (PARTITION BY {keys}) AS q1, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.75) OVER (PARTITION BY {keys}) AS q3 FROM ({source}) s) t) u GROUP BY {keys}"
        for c in cols
    ])


_OUT = "count(*) FILTER (WHERE x < lo OR x > hi)"
_OUT_PCT = f"round(coalesce({_OUT} * 100.0 / nullif(CAST(count(x) AS DOUBLE), 0), 0), 6)"

QUERIES["slice_numeric"] = lambda spark, sf: rounded(slices.slice_numeric(planted_lines(spark, sf), _BY, _NUMBERS))
ORACLE["slice_numeric"] = _per_slice(
    "count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, "
    "round(CASE WHEN count(x) >= 3 AND min(x) = max(x) THEN 0.0 ELSE skewness(x) END, 6) AS skewness, "
    "round(CASE WHEN count(x) >= 4 AND min(x) = max(x) THEN 0.0 ELSE kurtosis(x) END, 6) AS kurtosis, "
    "round(count(*) FILTER (WHERE x = 0) * 100.0 / nullif(CAST(count(x) AS DOUBLE), 0), 6) AS zeros_pct, "
    "round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS p75, "
    f"{_OUT} AS outlier_count, {_OUT_PCT} AS outlier_pct",
    _NUMBERS, _BY, PLANTED_SQL,
)

QUERIES["slice_outliers"] = lambda spark, sf: rounded(
    slices.slice_outliers(table(spark, sf, "lineitem").withColumn("cube", F.expr("l_quantity * l_quantity * l_quantity")), _FLAG, ["cube", "l_extendedprice"])
)
ORACLE["slice_outliers"] = _per_slice(
    f"count(x) AS n, {_OUT} AS outlier_count, {_OUT_PCT} AS outlier_pct, round(max(lo), 6) AS lower_fence, round(max(hi), 6) AS upper_fence",
    ["cube", "l_extendedprice"], _FLAG, "SELECT *, l_quantity * l_quantity * l_quantity AS cube FROM lineitem",
)

_MISSING = ["l_linestatus", "l_discount", "l_extendedprice", "l_line"]
QUERIES["slice_missing"] = lambda spark, sf: rounded(slices.slice_missing(planted_lines(spark, sf), _FLAG))
ORACLE["slice_missing"] = union_sql([
    f"SELECT l_returnflag, '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS null_count, "
    f"round((count(*) - count({c})) * 100.0 / CAST(count(*) AS DOUBLE), 6) AS null_pct FROM ({PLANTED_SQL}) p GROUP BY 1 HAVING count({c}) < count(*)"
    for c in _MISSING
])

_TEXTS = ["o_orderpriority", "day"]
_DAYS = "SELECT *, CASE WHEN o_totalprice > 1000 THEN {day} END AS day FROM {orders}"
QUERIES["slice_categorical"] = lambda spark, sf: rounded(slices.slice_categorical(
    spark.sql(_DAYS.replace("{day}", "date_format(o_orderdate, 'yyyy-MM')"), orders=table(spark, sf, "orders")), ["o_orderstatus"], _TEXTS))
ORACLE["slice_categorical"] = union_sql([
    f"SELECT o_orderstatus, '{c}' AS \"column\", CAST(sum(cnt) AS BIGINT) AS n, count(*) AS cardinality, arg_min(value, (-cnt, value)) AS mode, "
    "round(-sum(p * log2(p + CAST(1e-9 AS DOUBLE))), 6) AS entropy, round(coalesce(sum(p) FILTER (WHERE p < CAST(0.01 AS DOUBLE)), 0) * 100, 6) AS rare_pct FROM "
    "(SELECT *, cnt / CAST(sum(cnt) OVER (PARTITION BY o_orderstatus) AS DOUBLE) AS p FROM "
    f"(SELECT o_orderstatus, {c} AS value, count(*) AS cnt FROM ({_DAYS.format(day="strftime(o_orderdate, '%Y-%m')", orders='orders')}) o WHERE {c} IS NOT NULL GROUP BY 1, 2) v) w GROUP BY 1"
    for c in _TEXTS
])

_DRAWN = ["l_quantity", "l_extendedprice"]
_TESTED = 5_000


def _drawn_sql(c: str) -> str:
    draw = f"md5(concat_ws('|', '42', {', '.join(LINE_KEY)}))"
    return (
        f"SELECT l_returnflag, x FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {draw}, x) AS place "
        f"FROM (SELECT *, CAST({c} AS DOUBLE) AS x FROM ({PLANTED_SQL}) p) q WHERE x IS NOT NULL) r WHERE place <= {_TESTED}"
    )


QUERIES["slice_normality"] = lambda spark, sf: rounded(slices.slice_normality(planted_lines(spark, sf), _FLAG, LINE_KEY, _DRAWN, _TESTED))
ORACLE["slice_normality"] = union_sql([
    f"SELECT *, '{c}' AS \"column\", 'shapiro' AS method FROM ({shapiro_sql(_drawn_sql(c), _FLAG)}) t_{c}" for c in _DRAWN
])
