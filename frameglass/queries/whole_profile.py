"""The sections of a whole profile beside reference SQL, a row per section, item and metric."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tidy import union_all
from ..plans.report import profile
from .common import LINE_KEY, Query, fences_sql, table, union_sql
from .shapiro_sql import shapiro_sql

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Lines with planted nulls; the key stays whole.
_LINES = (
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, nullif(l_discount, CAST(0 AS DOUBLE)) AS l_discount, "
    "CASE WHEN l_quantity < 40 THEN l_quantity END AS l_quantity, CASE WHEN l_quantity > 45 THEN NULL ELSE l_returnflag END AS l_returnflag, "
    "CASE WHEN l_quantity < 3 THEN NULL ELSE l_linestatus END AS l_linestatus FROM {lineitem}"
)
_TEXTS = ["l_returnflag", "l_linestatus"]
_NUMBERS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity"]
_COLS = [*_NUMBERS, *_TEXTS]

#: What names a row of a section, and the fields of it that are compared.
_SECTIONS = {
    "shape": ([], ["n_rows", "n_cols"]),
    "missing": (["column"], ["null_count", "null_pct"]),
    "duplicates": ([], ["duplicate_rows", "duplicate_pct"]),
    "unique": (["column"], ["n_unique"]),
    "first_values": (["column", "rank"], ["value"]),
    "numeric": (["column"], ["n", "mean", "median", "std", "min", "max", "p25", "p75", "skewness", "kurtosis", "zeros_pct",
                             "outlier_count", "outlier_pct"]),
    "categorical": (["column"], ["n", "cardinality", "mode", "entropy", "rare_pct"]),
    "top_values": (["column", "rank"], ["value", "cnt", "pct"]),
    "histogram": (["column", "bin"], ["lo", "hi", "cnt"]),
    "normality": (["column"], ["n", "tested", "w", "p_value", "is_normal"]),
    "distributions": (["column"], ["shape", "lower_fence", "upper_fence"]),
    "pearson": (["col_a", "col_b"], ["value"]),
    "cramers_v": (["col_a", "col_b"], ["value"]),
    "quality": ([], ["completeness", "uniqueness", "consistency", "timeliness", "overall_score"]),
}


def _long(name: str, section: DataFrame) -> DataFrame:
    keys, fields = _SECTIONS[name]
    cells = F.inline(F.array(*[F.struct(F.lit(f).alias("metric"), F.col(f).cast("string").alias("shown")) for f in fields]))
    rows = section.select(F.lit(name).alias("section"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("item"), cells)
    number = F.expr("try_cast(shown AS DOUBLE)")
    return rows.select("section", "item", "metric", F.round(number, 6).alias("value"), F.when(number.isNull(), F.col("shown")).alias("text"))


def _profiled(spark, sf):
    lines = spark.sql(_LINES, lineitem=table(spark, sf, "lineitem"))
    found = profile(lines, "lines", order_by=LINE_KEY)
    return union_all([_long(name, found[name]) for name in _SECTIONS])


def _cells(section: str, item: str, source: str, values: Mapping[str, str], texts: Mapping[str, str] | None = None) -> str:
    """Rows of a section from a source with a row per item."""
    cells = [f"{{'m': '{m}', 'v': round(CAST({v} AS DOUBLE), 6), 't': CAST(NULL AS VARCHAR)}}" for m, v in values.items()]
    cells += [f"{{'m': '{m}', 'v': CAST(NULL AS DOUBLE), 't': CAST({t} AS VARCHAR)}}" for m, t in (texts or {}).items()]
    return (
        f"SELECT '{section}' AS section, item, u.m AS metric, u.v AS value, u.t AS text FROM "
        f"(SELECT {item} AS item, unnest([{', '.join(cells)}]) AS u FROM {source}) c"
    )


def _number_sql(c: str) -> list[str]:
    outside = "count(*) FILTER (WHERE x < lower_fence OR x > upper_fence)"
    metrics = {
        "n": "count(x)", "mean": "avg(x)", "median": "quantile_cont(x, 0.5)", "std": "stddev_samp(x)", "min": "min(x)", "max": "max(x)",
        "p25": "max(q1)", "p75": "max(q3)", "skewness": "skewness(x)", "kurtosis": "kurtosis(x)",
        "zeros_pct": "count(*) FILTER (WHERE x = 0) * 100.0 / count(x)", "outlier_count": outside, "outlier_pct": f"{outside} * 100.0 / count(x)",
        "lower_fence": "max(lower_fence)", "upper_fence": "max(upper_fence)",
    }
    wide = f"(SELECT {', '.join(f'{v} AS {m}' for m, v in metrics.items())} FROM (SELECT CAST({c} AS DOUBLE) AS x FROM s) a, ({fences_sql(c, 's')}) f) w"
    shape = "CASE WHEN skewness > 0.5 THEN 'right-skewed' WHEN skewness < -0.5 THEN 'left-skewed' ELSE 'approximately-normal' END"
    drawn = (
        f"SELECT 0 AS one, (SELECT count({c}) FROM s) AS n_all, CAST({c} AS DOUBLE) AS x FROM s WHERE {c} IS NOT NULL "
        f"ORDER BY md5(concat_ws('|', '42', {', '.join(LINE_KEY)})) LIMIT 5000"
    )
    tested = f"({shapiro_sql(drawn, ['one'], 'n_all,')}) t"
    width = "((SELECT max(x) - min(x) FROM v) / 10)"
    edge = lambda i: f"CASE WHEN {i} = 10 THEN (SELECT max(x) FROM v) ELSE (SELECT min(x) FROM v) + ({i}) * {width} END"
    within = f"(SELECT count(*) FROM v WHERE (x >= {edge('b')} OR b = 0) AND (x < {edge('b + 1')} OR b = 9))"
    bins = f"(WITH v AS (SELECT CAST({c} AS DOUBLE) AS x FROM s WHERE {c} IS NOT NULL) SELECT b, {edge('b')} AS lo, {edge('b + 1')} AS hi, {within} AS cnt FROM range(10) r(b)) h"
    return [
        _cells("numeric", f"'{c}'", wide, {m: m for m in list(metrics)[:13]}),
        _cells("distributions", f"'{c}'", wide, {m: m for m in list(metrics)[13:]}, {"shape": shape}),
        _cells("normality", f"'{c}'", tested, {"n": "n_all", "tested": "tested", "w": "w", "p_value": "p_value"}, {"is_normal": "is_normal"}),
        _cells("histogram", f"'{c}/' || b", bins, {"lo": "lo", "hi": "hi", "cnt": "cnt"}),
    ]


def _text_sql(c: str) -> list[str]:
    key = ", ".join(LINE_KEY)
    counted = (
        f"(SELECT *, row_number() OVER (ORDER BY cnt DESC, seen) AS r, row_number() OVER (ORDER BY cnt DESC, value) AS place FROM "
        f"(SELECT {c} AS value, count(*) AS cnt, cnt / CAST(sum(cnt) OVER () AS DOUBLE) AS p, min(row({key})) AS seen FROM s "
        f"WHERE {c} IS NOT NULL GROUP BY 1) a) b"
    )
    entropy = "-sum(p * log2(p + CAST(1e-9 AS DOUBLE)))"
    values = {"n": "sum(cnt)", "cardinality": "count(*)", "entropy": entropy, "rare_pct": "coalesce(sum(p) FILTER (WHERE p < 0.01), 0) * 100"}
    wide = f"(SELECT {', '.join(f'{v} AS {m}' for m, v in values.items())}, min(value) FILTER (WHERE place = 1) AS mode FROM {counted}) w"
    top = f"(SELECT * FROM {counted} WHERE r <= 5) w"
    return [
        _cells("categorical", f"'{c}'", wide, {m: m for m in values}, {"mode": "mode"}),
        _cells("top_values", f"'{c}/' || r", top, {"cnt": "cnt", "pct": "p * 100"}, {"value": "value"}),
    ]


def _column_sql(c: str) -> list[str]:
    firsts = (
        f"(SELECT {c} AS v, row_number() OVER (ORDER BY min(row({', '.join(LINE_KEY)}))) AS r FROM s GROUP BY 1 QUALIFY r <= 10) w"
    )
    first = ({}, {"value": "v"}) if c in _TEXTS else ({"value": "v"}, {})
    nulls = f"(SELECT count(*) AS n, count(*) - count({c}) AS nulls FROM s HAVING nulls > 0) w"
    return [
        _cells("unique", f"'{c}'", f"(SELECT count(DISTINCT {c}) AS d FROM s) w", {"n_unique": "d"}),
        _cells("missing", f"'{c}'", nulls, {"null_count": "nulls", "null_pct": "nulls * 100.0 / n"}),
        _cells("first_values", f"'{c}/' || r", firsts, *first),
    ]


def _pair_sql(a: str, b: str) -> str:
    x, y = (f"coalesce(CAST({c} AS DOUBLE), (SELECT avg({c}) FROM s))" for c in (a, b))
    return _cells("pearson", f"'{a}/{b}'", f"(SELECT corr(x, y) AS r FROM (SELECT {x} AS x, {y} AS y FROM s) q) w", {"value": "r"})


def _table_sql() -> list[str]:
    a, b = _TEXTS
    cramer = (
        "(SELECT sqrt(greatest(sum(cnt * cnt / (r * c)) - 1, 0) / CAST(least(count(DISTINCT a), count(DISTINCT b)) - 1 AS DOUBLE)) AS v FROM "
        "(SELECT a, b, CAST(cnt AS DOUBLE) AS cnt, CAST(sum(cnt) OVER (PARTITION BY a) AS DOUBLE) AS r, CAST(sum(cnt) OVER (PARTITION BY b) AS DOUBLE) AS c "
        f"FROM (SELECT {a} AS a, {b} AS b, count(*) AS cnt FROM s WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2) x) y) w"
    )
    nulls = " + ".join(f"count(*) - count({c})" for c in _COLS)
    rates = " + ".join(f"(SELECT count(*) FILTER (WHERE {c} < lower_fence OR {c} > upper_fence) FROM s, ({fences_sql(c, 's')}) f)" for c in _NUMBERS)
    parts = (
        f"(SELECT 1 - ({nulls}) / CAST(count(*) * {len(_COLS)} AS DOUBLE) AS complete, (SELECT count(*) FROM (SELECT DISTINCT * FROM s) u) / CAST(count(*) AS DOUBLE) AS uniq, "
        f"1 - ({rates}) / CAST(count(*) * {len(_NUMBERS)} AS DOUBLE) AS consistent FROM s) w"
    )
    score = "0.35 * round(complete, 4) + 0.25 * round(uniq, 4) + 0.25 * round(consistent, 4) + 0.15"
    repeats = "(SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM s) u) AS d FROM s) w"
    return [
        _cells("shape", "''", "(SELECT count(*) AS n FROM s) w", {"n_rows": "n", "n_cols": str(len(_COLS))}),
        _cells("duplicates", "''", repeats, {"duplicate_rows": "d", "duplicate_pct": "d * 100.0 / n"}),
        _cells("cramers_v", f"'{a}/{b}'", cramer, {"value": "v"}),
        _cells("quality", "''", parts, {"completeness": "complete", "uniqueness": "uniq", "consistency": "consistent", "timeliness": "1", "overall_score": score}),
    ]


QUERIES["profile_sections"] = _profiled
ORACLE["profile_sections"] = f"WITH s AS ({_LINES.format(lineitem='lineitem')}) " + union_sql(
    [
        *_table_sql(),
        *[part for c in _COLS for part in _column_sql(c)],
        *[part for c in _NUMBERS for part in _number_sql(c)],
        *[part for c in _TEXTS for part in _text_sql(c)],
        *[_pair_sql(a, b) for a, b in combinations(_NUMBERS, 2)],
    ]
)
