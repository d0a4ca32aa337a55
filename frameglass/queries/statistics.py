"""Queries over numeric and categorical statistics, associations and distributions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators.association import crosstab, cramers_v_pairs, pearson_pairs, top_pairs
from ..operators.categorical import categorical_profile, column_totals, entropy_and_rarity, top_values
from ..operators.distribution import (
    histogram,
    normality,
    outlier_preview,
    outlier_summary,
    shape_hints,
)
from ..operators.numeric import numeric_profile, quantile_table
from ..operators.sampling import row_sample
from ..operators.value_counts import mode_table, value_counts
from ..operators.value_index import ValueIndex
from .shapiro_sql import shapiro_sql
from .common import (
    LINE_KEY,
    LINE_NUMBERS,
    PLANTED_SQL,
    Query,
    fences_sql,
    per_number,
    planted_lines,
    rounded,
    table,
    union_sql,
)

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# --- numeric ------------------------------------------------------------------------


def _numeric(name: str, metrics: list[str], sql: str) -> None:
    QUERIES[name] = lambda spark, sf: rounded(numeric_profile(table(spark, sf, "lineitem"), metrics=metrics))
    ORACLE[name] = per_number(sql)


_numeric("num_mean", ["mean"], "round(avg(x), 6) AS mean")
_numeric("num_std", ["std"], "round(stddev_samp(x), 6) AS std")
_numeric("num_min_max", ["min", "max"], "round(min(x), 6) AS min, round(max(x), 6) AS max")
_numeric(
    "num_zeros_pct", ["zeros_pct"], "round(count(*) FILTER (WHERE x = 0) * 100.0 / CAST(count(x) AS DOUBLE), 6) AS zeros_pct"
)

# A constant column shows the guards of skewness and kurtosis.
_SHAPED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "one"]
_SHAPED_SQL = "(SELECT *, 1 AS one FROM lineitem) s"
ORACLE["num_skewness"] = per_number(
    "round(CASE WHEN count(x) >= 3 AND min(x) = max(x) THEN 0.0 ELSE skewness(x) END, 6) AS skewness", _SHAPED, _SHAPED_SQL
)
ORACLE["num_kurtosis"] = per_number(
    "round(CASE WHEN count(x) >= 4 AND min(x) = max(x) THEN 0.0 ELSE kurtosis(x) END, 6) AS kurtosis", _SHAPED, _SHAPED_SQL
)


def _shaped(metric: str) -> Query:
    return lambda spark, sf: rounded(
        numeric_profile(table(spark, sf, "lineitem").withColumn("one", F.lit(1)), _SHAPED, [metric])
    )


QUERIES["num_skewness"] = _shaped("skewness")
QUERIES["num_kurtosis"] = _shaped("kurtosis")

QUERIES["num_quantiles"] = lambda spark, sf: rounded(quantile_table(table(spark, sf, "lineitem"), LINE_NUMBERS))
ORACLE["num_quantiles"] = per_number(
    "round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS p75"
)



def _indexed(spark, sf):
    lines = table(spark, sf, "lineitem")
    index = ValueIndex(lines, LINE_NUMBERS)
    found = index.quantiles({c: _PLACES for c in LINE_NUMBERS})
    rows = [(c, *[q[p] for p in _PLACES]) for c, q in found.items()]
    shown = spark.createDataFrame(rows, "column string, p01 double, p25 double, p75 double, p99 double")
    return rounded(shown.join(index.n_unique(LINE_NUMBERS), "column"))


_PLACES = (0.01, 0.25, 0.75, 0.99)
QUERIES["indexed_order_statistics"] = _indexed
ORACLE["indexed_order_statistics"] = per_number(
    ", ".join(f"round(quantile_cont(x, {p}), 6) AS p{int(p * 100):02}" for p in _PLACES) + ", count(DISTINCT x) AS n_unique"
)

# Products spread far enough to have outliers.
_SPREAD = "SELECT *, l_extendedprice * l_discount * l_tax AS duty, l_quantity * l_quantity * l_quantity AS cube FROM {lineitem}"
_SPREAD_COLS = ["l_quantity", "l_extendedprice", "l_discount", "duty", "cube"]
_SPREAD_SQL = f"({_SPREAD.format(lineitem='lineitem')}) w"


def _spread(spark, sf):
    return spark.sql(_SPREAD, lineitem=table(spark, sf, "lineitem"))


def _outlier_sql(select: str) -> str:
    return union_sql(
        [
            f"SELECT '{c}' AS \"column\", {select} FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {_SPREAD_SQL}) t, "
            f"({fences_sql(c, _SPREAD_SQL)}) f"
            for c in _SPREAD_COLS
        ]
    )


_OUT = "count(*) FILTER (WHERE x < lower_fence OR x > upper_fence)"
_OUT_PCT = f"round({_OUT} * 100.0 / CAST(count(x) AS DOUBLE), 6)"
QUERIES["num_outliers"] = lambda spark, sf: rounded(
    numeric_profile(_spread(spark, sf), _SPREAD_COLS, ["outlier_count", "outlier_pct"])
)
ORACLE["num_outliers"] = _outlier_sql(f"{_OUT} AS outlier_count, {_OUT_PCT} AS outlier_pct")

QUERIES["numeric_profile"] = lambda spark, sf: rounded(numeric_profile(_spread(spark, sf), _SPREAD_COLS))
ORACLE["numeric_profile"] = _outlier_sql(
    "count(x) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(stddev_samp(x), 6) AS std, "
    "round(min(x), 6) AS min, round(max(x), 6) AS max, round(quantile_cont(x, 0.25), 6) AS p25, "
    "round(quantile_cont(x, 0.75), 6) AS p75, round(skewness(x), 6) AS skewness, round(kurtosis(x), 6) AS kurtosis, "
    "round(count(*) FILTER (WHERE x = 0) * 100.0 / CAST(count(x) AS DOUBLE), 6) AS zeros_pct, "
    f"{_OUT} AS outlier_count, {_OUT_PCT} AS outlier_pct"
)

# --- categorical --------------------------------------------------------------------

_CAT = ["o_orderstatus", "o_orderpriority", "customer"]
_CAT_FRAME = (
    "SELECT CASE WHEN o_totalprice > 450000 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, "
    "concat('C', CAST(o_custkey AS {text})) AS customer FROM {orders}"
)
_VC_SQL = (
    f"WITH s AS ({_CAT_FRAME.format(text='VARCHAR', orders='orders')}), vc AS ("
    + union_sql(
        [
            f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS cnt FROM s WHERE {c} IS NOT NULL GROUP BY {c}"
            for c in _CAT
        ]
    )
    + "), p AS (SELECT *, cnt / CAST(sum(cnt) OVER (PARTITION BY \"column\") AS DOUBLE) AS p, "
    'row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS rank FROM vc) '
)


def _cats(spark, sf):
    return spark.sql(_CAT_FRAME.replace("{text}", "STRING"), orders=table(spark, sf, "orders"))


def _vc(spark, sf):
    return value_counts(_cats(spark, sf), _CAT)


QUERIES["value_counts"] = _vc
ORACLE["value_counts"] = _VC_SQL + 'SELECT "column", value, cnt FROM vc'
QUERIES["cat_cardinality"] = lambda spark, sf: column_totals(_vc(spark, sf)).select("column", "cardinality")
ORACLE["cat_cardinality"] = _VC_SQL + 'SELECT "column", count(*) AS cardinality FROM vc GROUP BY "column"'
QUERIES["cat_top_values"] = lambda spark, sf: rounded(top_values(_cats(spark, sf), _CAT))
ORACLE["cat_top_values"] = _VC_SQL + (
    'SELECT "column", CAST(rank AS INTEGER) AS rank, value, cnt, round(p * 100, 6) AS pct FROM p WHERE rank <= 5'
)
QUERIES["cat_entropy"] = lambda spark, sf: rounded(entropy_and_rarity(_vc(spark, sf)).select("column", "entropy"))
ORACLE["cat_entropy"] = _VC_SQL + (
    'SELECT "column", round(-sum(p * log2(p + CAST(1e-9 AS DOUBLE))), 6) AS entropy FROM p GROUP BY "column"'
)
QUERIES["cat_mode"] = lambda spark, sf: mode_table(_vc(spark, sf))
ORACLE["cat_mode"] = _VC_SQL + 'SELECT "column", value AS mode FROM p WHERE rank = 1'
QUERIES["cat_rare_pct"] = lambda spark, sf: rounded(entropy_and_rarity(_vc(spark, sf)).select("column", "rare_pct"))
ORACLE["cat_rare_pct"] = _VC_SQL + (
    'SELECT "column", round(coalesce(sum(p) FILTER (WHERE p < CAST(0.01 AS DOUBLE)), 0) * 100, 6) AS rare_pct FROM p GROUP BY "column"'
)
QUERIES["categorical_profile"] = lambda spark, sf: rounded(categorical_profile(_cats(spark, sf), _CAT))
ORACLE["categorical_profile"] = _VC_SQL + (
    'SELECT "column", CAST(sum(cnt) AS BIGINT) AS n, count(*) AS cardinality, min(value) FILTER (WHERE rank = 1) AS mode, '
    "round(-sum(p * log2(p + CAST(1e-9 AS DOUBLE))), 6) AS entropy, "
    "round(coalesce(sum(p) FILTER (WHERE p < CAST(0.01 AS DOUBLE)), 0) * 100, 6) AS rare_pct "
    'FROM p GROUP BY "column"'
)

# --- associations -------------------------------------------------------------------

_PAIR_NUMBERS = ["l_quantity", "l_discount", "l_extendedprice", "l_line", "one"]
_PAIRED = f"SELECT *, 1 AS one FROM ({PLANTED_SQL}) q"


def _filled_pearson(a: str, b: str, pos: int) -> str:
    x = f"coalesce(CAST({a} AS DOUBLE), (SELECT avg({a}) FROM pl))"
    y = f"coalesce(CAST({b} AS DOUBLE), (SELECT avg({b}) FROM pl))"
    return (
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {pos} AS pos, CASE WHEN stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 0.0 "
        f"ELSE covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS value FROM (SELECT {x} AS x, {y} AS y FROM pl) t"
    )


_PEARSON_SQL = union_sql(
    [_filled_pearson(a, b, i) for i, (a, b) in enumerate(combinations(_PAIR_NUMBERS, 2))]
)


def _pearson(spark, sf):
    return pearson_pairs(planted_lines(spark, sf).withColumn("one", F.lit(1)), _PAIR_NUMBERS)


QUERIES["pearson_pairs"] = lambda spark, sf: rounded(_pearson(spark, sf)).select("col_a", "col_b", "value")
ORACLE["pearson_pairs"] = (
    f"WITH pl AS ({_PAIRED}) SELECT col_a, col_b, round(value, 6) AS value FROM ({_PEARSON_SQL}) t"
)

# A customer column has far more than 50 values and must drop out.
_TAGS = (
    "SELECT CASE WHEN o_totalprice > 450000 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, "
    "CAST(year(o_orderdate) AS {text}) AS order_year, CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS size, "
    "concat('C', CAST(o_custkey AS {text})) AS customer FROM {orders}"
)
_TAG_COLS = ["o_orderstatus", "o_orderpriority", "order_year", "size"]


def _cramers_sql(a: str, b: str, pos: int) -> str:
    return (
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {pos} AS pos, coalesce(sqrt(greatest(s - 1, 0) / "
        "nullif(CAST(least(na, nb) - 1 AS DOUBLE), 0)), 0) AS value FROM (SELECT sum(cnt * cnt / (r * c)) AS s, "
        "count(DISTINCT a) AS na, count(DISTINCT b) AS nb FROM (SELECT a, b, CAST(cnt AS DOUBLE) AS cnt, "
        "CAST(sum(cnt) OVER (PARTITION BY a) AS DOUBLE) AS r, CAST(sum(cnt) OVER (PARTITION BY b) AS DOUBLE) AS c FROM "
        f"(SELECT {a} AS a, {b} AS b, count(*) AS cnt FROM tg WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2) x) y) z"
    )


_TAGS_SQL = _TAGS.format(text="VARCHAR", orders="orders")
_CRAMERS_SQL = union_sql([_cramers_sql(a, b, i) for i, (a, b) in enumerate(combinations(_TAG_COLS, 2))])


def _cramers(spark, sf):
    return cramers_v_pairs(spark.sql(_TAGS.replace("{text}", "STRING"), orders=table(spark, sf, "orders")))


QUERIES["cramers_v_pairs"] = lambda spark, sf: rounded(_cramers(spark, sf)).select("col_a", "col_b", "value")
ORACLE["cramers_v_pairs"] = (
    f"WITH tg AS ({_TAGS_SQL}) SELECT col_a, col_b, round(value, 6) AS value FROM ({_CRAMERS_SQL}) t"
)

QUERIES["top_corr_pairs"] = lambda spark, sf: rounded(top_pairs(_pearson(spark, sf), _cramers(spark, sf)))
ORACLE["top_corr_pairs"] = (
    f"WITH pl AS ({_PAIRED}), tg AS ({_TAGS_SQL}) SELECT col_a, col_b, method, round(value, 6) AS value FROM ("
    f"SELECT *, 'pearson' AS method, 0 AS kind FROM ({_PEARSON_SQL}) a UNION ALL "
    f"SELECT *, 'cramers_v' AS method, 1 AS kind FROM ({_CRAMERS_SQL}) b) t "
    "ORDER BY abs(round(value, 4)) DESC, kind, pos LIMIT 5"
)

QUERIES["crosstab"] = lambda spark, sf: crosstab(planted_lines(spark, sf), "l_returnflag", "l_linestatus")
ORACLE["crosstab"] = (
    f"SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS cnt FROM ({PLANTED_SQL}) p "
    "WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2"
)

_SAMPLE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
QUERIES["row_sample"] = lambda spark, sf: row_sample(
    table(spark, sf, "lineitem").select(*_SAMPLE_KEY, "l_extendedprice"),
    ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 5_000,
).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
ORACLE["row_sample"] = (
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY "
    "md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)), "
    "l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5000"
)

# --- distributions ------------------------------------------------------------------

QUERIES["normality_shapiro"] = lambda spark, sf: rounded(
    normality(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], key=LINE_KEY)
)
_TESTED_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORACLE["normality_shapiro"] = union_sql([
    f"SELECT '{c}' AS \"column\", n_all AS n, tested, 'shapiro' AS method, w, p_value, is_normal FROM (" + shapiro_sql(
        f"SELECT 0 AS one, (SELECT count({c}) FROM lineitem) AS n_all, CAST({c} AS DOUBLE) AS x FROM lineitem "
        f"ORDER BY md5(concat_ws('|', '42', {', '.join(LINE_KEY)})) LIMIT 5000", ["one"], "n_all,") + f") t_{c}"
    for c in _TESTED_COLS
])
QUERIES["shape_hint"] = lambda spark, sf: shape_hints(_spread(spark, sf), _SPREAD_COLS)
ORACLE["shape_hint"] = per_number(
    "CASE WHEN skewness(x) > 0.5 THEN 'right-skewed' WHEN skewness(x) < -0.5 THEN 'left-skewed' "
    "ELSE 'approximately-normal' END AS shape",
    _SPREAD_COLS,
    _SPREAD_SQL,
)


def _histogram_sql(c: str) -> str:
    edge = lambda i: "hi" if i == 10 else f"(lo + {i} * ((hi - lo) / 10))"
    cases = " ".join(f"WHEN x < {edge(i)} THEN {i - 1}" for i in range(1, 10))
    bounds = " ".join(f"WHEN {i} THEN {edge(i)}" for i in range(11))
    return (
        f"SELECT '{c}' AS \"column\", CAST(b AS INTEGER) AS bin, round(CASE b {bounds} END, 6) AS lo, "
        f"round(CASE b + 1 {bounds} END, 6) AS hi, coalesce(cnt, 0) AS cnt FROM "
        f"(SELECT b, lo, hi FROM range(10) r(b), (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {_SPREAD_SQL}) v) m) g "
        f"LEFT JOIN (SELECT CASE {cases} ELSE 9 END AS bb, count(*) AS cnt FROM "
        f"(SELECT CAST({c} AS DOUBLE) AS x FROM {_SPREAD_SQL}) v, (SELECT min(x) AS lo, max(x) AS hi FROM "
        f"(SELECT CAST({c} AS DOUBLE) AS x FROM {_SPREAD_SQL}) v) m GROUP BY 1) h ON g.b = h.bb"
    )


QUERIES["histogram"] = lambda spark, sf: rounded(histogram(_spread(spark, sf), _SPREAD_COLS))
ORACLE["histogram"] = union_sql([_histogram_sql(c) for c in _SPREAD_COLS])

QUERIES["outlier_fences"] = lambda spark, sf: rounded(outlier_summary(_spread(spark, sf), _SPREAD_COLS))
ORACLE["outlier_fences"] = _outlier_sql(
    f"count(x) AS n, {_OUT} AS outlier_count, {_OUT_PCT} AS outlier_pct, round(max(lower_fence), 6) AS lower_fence, "
    "round(max(upper_fence), 6) AS upper_fence"
)

QUERIES["outlier_preview"] = lambda spark, sf: rounded(
    outlier_preview(_spread(spark, sf), LINE_KEY, ["duty", "cube"])
)
ORACLE["outlier_preview"] = union_sql(
    [
        f"SELECT * FROM (SELECT '{c}' AS \"column\", {', '.join(LINE_KEY)}, round({c}, 6) AS value FROM {_SPREAD_SQL}, "
        f"({fences_sql(c, _SPREAD_SQL)}) f WHERE {c} < lower_fence OR {c} > upper_fence "
        f"ORDER BY {', '.join(LINE_KEY)} LIMIT 10) t_{c}"
        for c in ("duty", "cube")
    ]
)
