"""Queries over the quality score, the full report, the digests and the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import digest, quality
from ..operators.association import cramers_v_pairs, pearson_pairs, top_pairs
from ..operators.categorical import categorical_profile, top_values
from ..operators.distribution import normality, outlier_summary, shape_hints
from ..operators.duplicates import duplicate_rows
from ..operators.numeric import numeric_profile
from ..operators.schema import column_types, logical_size, null_counts, table_shape
from ..operators.temporal import datetime_profile
from ..operators.tidy import union_all
from ..operators.value_counts import n_unique
from ..plans.report import profile, sections_long
from ..session import scratch_path
from ..sources import write_report
from .common import LINE_KEY, PLANTED_SQL, Query, fences_sql, planted_lines, rounded, table, union_sql
from .shapiro_sql import shapiro_sql
from .timeline import season_sql

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# A table with planted nulls, repeated rows and outliers.
_DIRTY = "SELECT l_quantity, l_discount, l_line, l_returnflag, l_linestatus, l_extendedprice * l_discount AS cost FROM p"
_DIRTY_COLS = ["l_quantity", "l_discount", "l_line", "l_returnflag", "l_linestatus", "cost"]
_DIRTY_NUMBERS = ["l_quantity", "l_discount", "l_line", "cost"]
_D = f"WITH p AS ({PLANTED_SQL}), d AS ({_DIRTY}) "


def _dirty(spark, sf):
    return spark.sql(_DIRTY.replace("FROM p", "FROM {p}"), p=planted_lines(spark, sf))


_NULLS = " + ".join(f"(count(*) - count({c}))" for c in _DIRTY_COLS)
_COMPLETE = f"(SELECT 1 - ({_NULLS}) / CAST(count(*) * 6 AS DOUBLE) FROM d)"
_DUPS = "((SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d) x))"
_UNIQUE = f"(1 - {_DUPS} / CAST((SELECT count(*) FROM d) AS DOUBLE))"
_RATES = " + ".join(
    f"(SELECT count(*) FILTER (WHERE {c} < lower_fence OR {c} > upper_fence) / CAST(count(*) AS DOUBLE) FROM d, ({fences_sql(c, 'd')}) f)"
    for c in _DIRTY_NUMBERS
)
_CONSISTENT = f"(1 - ({_RATES}) / 4)"

QUERIES["completeness"] = lambda spark, sf: rounded(quality.completeness(_dirty(spark, sf)))
ORACLE["completeness"] = _D + f"SELECT round({_COMPLETE}, 6) AS completeness"
QUERIES["uniqueness"] = lambda spark, sf: rounded(quality.uniqueness(_dirty(spark, sf)))
ORACLE["uniqueness"] = _D + f"SELECT round({_UNIQUE}, 6) AS uniqueness"
QUERIES["consistency"] = lambda spark, sf: rounded(quality.consistency(_dirty(spark, sf)))
ORACLE["consistency"] = _D + f"SELECT round({_CONSISTENT}, 6) AS consistency"

# First Mondays with two months of each year left out: a frequency with gaps.
_MONDAYS = "SELECT DISTINCT l_shipdate AS monday FROM {lineitem} WHERE {weekday} = 1 AND day(l_shipdate) <= 7 AND month(l_shipdate) NOT IN (3, 7)"


def _mondays(spark, sf):
    text = _MONDAYS.replace("{weekday}", "weekday(l_shipdate) + 1")
    return spark.sql(text, lineitem=table(spark, sf, "lineitem"))


_GAPS_SQL = (
    "SELECT (year(max(monday)) - year(min(monday))) * 12 + month(max(monday)) - month(min(monday)) + 1 - count(*) AS gaps, "
    "(epoch_us(max(monday)) - epoch_us(min(monday))) // 86400000000 AS days FROM ("
    + _MONDAYS.format(lineitem="lineitem", weekday="isodow(l_shipdate)")
    + ") m"
)
QUERIES["timeliness"] = lambda spark, sf: rounded(quality.timeliness(datetime_profile(_mondays(spark, sf))))
ORACLE["timeliness"] = f"SELECT round(1 - least(gaps / CAST(days AS DOUBLE), 1), 6) AS timeliness FROM ({_GAPS_SQL}) g"


def _scores(spark, sf):
    dirty = _dirty(spark, sf)
    # Four one-row tables, joined on their only row.
    one = lambda df: df.withColumn("row", F.lit(1))
    parts = [
        quality.completeness(dirty),
        quality.uniqueness(dirty),
        quality.consistency(dirty),
        quality.timeliness(datetime_profile(_mondays(spark, sf))),
    ]
    joined = one(parts[0])
    for part in parts[1:]:
        joined = joined.join(one(part), "row")
    return quality.overall(joined.drop("row"))


QUERIES["overall_score"] = lambda spark, sf: rounded(_scores(spark, sf))
ORACLE["overall_score"] = _D + (
    f", s AS (SELECT {_COMPLETE} AS completeness, {_UNIQUE} AS uniqueness, {_CONSISTENT} AS consistency, "
    f"(SELECT 1 - least(gaps / CAST(days AS DOUBLE), 1) FROM ({_GAPS_SQL}) g) AS timeliness) "
    "SELECT round(completeness, 6) AS completeness, round(uniqueness, 6) AS uniqueness, round(consistency, 6) AS consistency, "
    "round(timeliness, 6) AS timeliness, round(CAST(0.35 AS DOUBLE) * round(completeness, 4) + CAST(0.25 AS DOUBLE) * round(uniqueness, 4) + "
    "CAST(0.25 AS DOUBLE) * round(consistency, 4) + CAST(0.15 AS DOUBLE) * round(timeliness, 4), 6) AS overall_score FROM s"
)


def _flags(spark, sf):
    dirty = _dirty(spark, sf)
    return quality.quality_flags(
        null_counts(dirty), duplicate_rows(dirty), datetime_profile(_mondays(spark, sf))
    )


_NULL_PCT = {c: f"(SELECT round((count(*) - count({c})) * 100.0 / CAST(count(*) AS DOUBLE), 2) FROM d)" for c in _DIRTY_COLS}
_DUP_PCT = f"round({_DUPS} * 100.0 / CAST((SELECT count(*) FROM d) AS DOUBLE), 2)"
QUERIES["quality_flags"] = _flags
ORACLE["quality_flags"] = _D + union_sql(
    [
        f"SELECT 'nulls' AS kind, '{c}' AS \"column\", 'high null in ''{c}'' (' || CAST({pct} AS DOUBLE) || '%)' AS flag WHERE {pct} > 5"
        for c, pct in _NULL_PCT.items()
    ]
    + [
        f"SELECT 'duplicates', NULL, 'duplicate rows: ' || CAST({_DUP_PCT} AS DOUBLE) || '%' WHERE {_DUP_PCT} > 1",
        f"SELECT 'gaps', 'monday', gaps || ' datetime gaps in ''monday''' FROM ({_GAPS_SQL}) g WHERE gaps > 0",
    ]
)


# --- the full report ----------------------------------------------------------------


def _report(spark, sf):
    lines = table(spark, sf, "lineitem")
    return sections_long(spark, [profile(lines, "lineitem", order_by=LINE_KEY)])


QUERIES["profile_report"] = _report


def _written(spark, sf):
    report = profile(table(spark, sf, "customer"), "customer.parquet", order_by=["c_custkey"]).to_dict()
    path = scratch_path(spark, "report")
    write_report(spark, report, path)
    whole = spark.read.text(path, wholetext=True)
    field = lambda p, kind, name: F.get_json_object("value", f"$.eda_report.{p}").cast(kind).alias(name)
    return whole.select(
        field("meta.source_file", "string", "source_file"),
        field("schema.n_rows", "bigint", "n_rows"),
        field("schema.n_cols", "int", "n_cols"),
        field("missing_and_duplicates.duplicate_rows", "bigint", "duplicate_rows"),
        field("univariate.categorical.c_mktsegment.cardinality", "bigint", "segments"),
        F.round(field("univariate.numeric.c_acctbal.mean", "double", "m"), 6).alias("mean_balance"),
        field("data_quality_score.completeness", "double", "completeness"),
    )


QUERIES["write_report"] = _written
ORACLE["write_report"] = (
    "SELECT 'customer.parquet' AS source_file, count(*) AS n_rows, 5 AS n_cols, CAST(0 AS BIGINT) AS duplicate_rows, "
    "count(DISTINCT c_mktsegment) AS segments, round(avg(c_acctbal), 6) AS mean_balance, CAST(1 AS DOUBLE) AS completeness FROM customer"
)

# --- digests over the profiles of several tables ------------------------------------

_TABLES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "dirty": _DIRTY_COLS,
}
_NUMBERS = {"customer": ["c_custkey", "c_nationkey", "c_acctbal"], "part": ["p_partkey", "p_size", "p_retailprice"],
            "dirty": _DIRTY_NUMBERS}
_SOURCE = {"customer": "customer", "part": "part", "dirty": "d"}


def _frames(spark, sf):
    return {
        "customer": table(spark, sf, "customer"),
        "part": table(spark, sf, "part"),
        "dirty": _dirty(spark, sf),
    }


def _tagged(spark, sf, section):
    return union_all(
        [section(df).withColumn("table", F.lit(name)) for name, df in _frames(spark, sf).items()]
    )


QUERIES["digest_columns"] = lambda spark, sf: rounded(
    digest.digest_columns(
        _tagged(spark, sf, column_types),
        _tagged(spark, sf, lambda df: n_unique(df, df.columns)),
        _tagged(spark, sf, null_counts),
    )
)
_SHORT = {"c_name": "str", "c_mktsegment": "str", "p_name": "str", "p_brand": "str", "p_type": "str", "l_returnflag": "str",
          "l_linestatus": "str", "c_nationkey": "int32", "p_size": "int32", "l_line": "int32", "c_acctbal": "float",
          "p_retailprice": "float", "l_quantity": "float", "l_discount": "float", "cost": "float", "c_custkey": "int",
          "p_partkey": "int"}
ORACLE["digest_columns"] = _D + union_sql(
    [
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{_SHORT[c]}' AS type, count(DISTINCT {c}) AS \"unique\", "
        f"round((count(*) - count({c})) * 100.0 / CAST(count(*) AS DOUBLE), 6) AS null_pct FROM {_SOURCE[t]}"
        for t, cols in _TABLES.items()
        for c in cols
    ]
)

QUERIES["digest_numeric"] = lambda spark, sf: rounded(digest.digest_numeric(_tagged(spark, sf, numeric_profile)))
_OUT = "count(*) FILTER (WHERE x < lower_fence OR x > upper_fence) * 100.0 / CAST(count(x) AS DOUBLE)"


def _number_sql(select: str) -> str:
    return union_sql(
        [
            f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {select} FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {_SOURCE[t]}) v, "
            f"({fences_sql(c, _SOURCE[t])}) f"
            for t, cols in _NUMBERS.items()
            for c in cols
        ]
    )


ORACLE["digest_numeric"] = _D + _number_sql(
    "round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(stddev_samp(x), 4) AS std, "
    "round(min(x), 6) AS min, round(max(x), 6) AS max, round(skewness(x), 3) AS skewness, "
    f"round(count(*) FILTER (WHERE x = 0) * 100.0 / CAST(count(x) AS DOUBLE), 6) AS zeros_pct, round({_OUT}, 6) AS outlier_pct"
)

QUERIES["digest_categorical"] = lambda spark, sf: digest.digest_categorical(
    _tagged(spark, sf, categorical_profile), _tagged(spark, sf, top_values)
)


def _categorical_sql(t: str, c: str) -> str:
    return (
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", card AS cardinality, CASE WHEN NOT id THEN mode END AS mode, "
        "CASE WHEN NOT id THEN top_3 END AS top_3, CASE WHEN id THEN 'high-cardinality identifier' END AS note FROM ("
        "SELECT count(*) AS card, count(*) > 1000 AND round(sum(p) FILTER (WHERE p < CAST(0.01 AS DOUBLE)) * 100, 2) = 100 IS TRUE AS id, "
        "min(value) FILTER (WHERE r = 1) AS mode, string_agg(value || ' (' || CAST(round(p * 100, 2) AS DOUBLE) || '%)', ', ' ORDER BY r) "
        "FILTER (WHERE r <= 3) AS top_3 FROM (SELECT value, cnt / CAST(sum(cnt) OVER () AS DOUBLE) AS p, "
        f"row_number() OVER (ORDER BY cnt DESC, value) AS r FROM (SELECT {c} AS value, count(*) AS cnt FROM {_SOURCE[t]} "
        f"WHERE {c} IS NOT NULL GROUP BY 1) a) b) e"
    )


ORACLE["digest_categorical"] = _D + union_sql(
    [_categorical_sql(t, c) for t, cols in _TABLES.items() for c in cols if _SHORT[c] == "str"]
)

QUERIES["digest_distributions"] = lambda spark, sf: rounded(
    digest.digest_distributions(
        _tagged(spark, sf, shape_hints), _normality(spark, sf), _tagged(spark, sf, outlier_summary)
    )
)
# Rows are drawn by these keys, so the samples are the same under any layout.
_KEYS = {"customer": ["c_custkey"], "part": ["p_partkey"], "dirty": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]}
_KEYED = _DIRTY.replace("SELECT ", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ")


def _normality(spark, sf):
    keyed = {**_frames(spark, sf), "dirty": spark.sql(_KEYED.replace("FROM p", "FROM {p}"), p=planted_lines(spark, sf))}
    return union_all([normality(df, _NUMBERS[t], key=_KEYS[t]).withColumn("table", F.lit(t)) for t, df in keyed.items()])


def _distribution_sql(t: str, c: str) -> str:
    drawn = (
        f"SELECT 0 AS one, CAST({c} AS DOUBLE) AS x FROM {'k' if t == 'dirty' else _SOURCE[t]} WHERE {c} IS NOT NULL "
        f"ORDER BY md5(concat_ws('|', '42', {', '.join(_KEYS[t])})) LIMIT 5000"
    )
    shape = "CASE WHEN skewness(x) > 0.5 THEN 'right-skewed' WHEN skewness(x) < -0.5 THEN 'left-skewed' ELSE 'approximately-normal' END"
    return (
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", shape, is_normal, outlier_pct FROM (SELECT {shape} AS shape, round({_OUT}, 6) AS outlier_pct "
        f"FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {_SOURCE[t]}) v, ({fences_sql(c, _SOURCE[t])}) f) a, ({shapiro_sql(drawn, ['one'])}) b"
    )


ORACLE["digest_distributions"] = _D + f", k AS ({_KEYED}) " + union_sql(
    [_distribution_sql(t, c) for t, cols in _NUMBERS.items() for c in cols]
)

QUERIES["digest_correlations"] = lambda spark, sf: rounded(
    digest.digest_correlations(
        union_all(
            [
                top_pairs(pearson_pairs(df), cramers_v_pairs(df)).withColumn("table", F.lit(name))
                for name, df in {"dirty": _dirty(spark, sf)}.items()
            ]
        )
    )
)


def _dirty_pair(a: str, b: str, pos: int) -> str:
    x, y = (f"coalesce(CAST({c} AS DOUBLE), (SELECT avg({c}) FROM d))" for c in (a, b))
    return f"SELECT '{a}' AS col_a, '{b}' AS col_b, 'pearson' AS method, 0 AS kind, {pos} AS pos, corr(x, y) AS value FROM (SELECT {x} AS x, {y} AS y FROM d) t"


_PAIRS = [(a, b) for i, a in enumerate(_DIRTY_NUMBERS) for b in _DIRTY_NUMBERS[i + 1 :]]
_CRAMERS = (
    "SELECT 'l_returnflag' AS col_a, 'l_linestatus' AS col_b, 'cramers_v' AS method, 1 AS kind, 0 AS pos, sqrt(greatest(sum(cnt * cnt / (r * c)) - 1, 0) / "
    "CAST(least(count(DISTINCT a), count(DISTINCT b)) - 1 AS DOUBLE)) AS value FROM (SELECT a, b, CAST(cnt AS DOUBLE) AS cnt, "
    "CAST(sum(cnt) OVER (PARTITION BY a) AS DOUBLE) AS r, CAST(sum(cnt) OVER (PARTITION BY b) AS DOUBLE) AS c FROM (SELECT l_returnflag AS a, "
    "l_linestatus AS b, count(*) AS cnt FROM d WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2) x) y"
)
ORACLE["digest_correlations"] = _D + (
    f", k AS ({union_sql([_dirty_pair(a, b, i) for i, (a, b) in enumerate(_PAIRS)] + [_CRAMERS])}), "
    "t AS (SELECT * FROM k ORDER BY abs(round(value, 4)) DESC, kind, pos LIMIT 5) "
    "SELECT 'dirty' AS \"table\", col_a, col_b, method, round(value, 6) AS value FROM t WHERE abs(round(value, 4)) > 0.1"
)

QUERIES["digest_datetime"] = lambda spark, sf: digest.digest_datetime(
    union_all(
        [
            datetime_profile(_mondays(spark, sf)).withColumn("table", F.lit("mondays")),
            datetime_profile(table(spark, sf, "orders")).withColumn("table", F.lit("orders")),
        ]
    )
)
_WHEN = (
    "SELECT strftime(min({c}), '%Y-%m-%d') AS lo, strftime(max({c}), '%Y-%m-%d') AS hi, "
    "(epoch_us(max({c})) - epoch_us(min({c}))) // 86400000000 AS span FROM {source}"
)
_MONDAYS_SQL = "(" + _MONDAYS.format(lineitem="lineitem", weekday="isodow(l_shipdate)") + ") q"


def _fields_sql(name: str, column: str, fields: dict[str, str], source: str) -> str:
    return union_sql(
        [
            f"SELECT '{name}' AS \"table\", '{column}' AS \"column\", '{f}' AS field, CAST({v} AS VARCHAR) AS value FROM {source}"
            for f, v in fields.items()
        ]
    )


_COMMON = {"min_date": "lo", "max_date": "hi", "date_range_days": "span"}
ORACLE["digest_datetime"] = (
    f"WITH o AS ({_WHEN.format(c='o_orderdate', source='orders')}), m AS ({_WHEN.format(c='monday', source=_MONDAYS_SQL)}), "
    f"g AS ({_GAPS_SQL}) "
    + _fields_sql("orders", "o_orderdate", {**_COMMON, "seasonality_hint": season_sql("SELECT o_orderdate AS ts FROM orders")}, "o")
    + " UNION ALL "
    + _fields_sql("mondays", "monday", {**_COMMON, "inferred_freq": "'WOM-1MON'", "gaps_count": "gaps",
                                        "seasonality_hint": season_sql("SELECT monday AS ts FROM " + _MONDAYS_SQL)}, "m, g")
)


def _digest_quality(spark, sf):
    tag = lambda df: df.withColumn("table", F.lit("dirty"))
    return rounded(digest.digest_quality(tag(_scores(spark, sf)), tag(_flags(spark, sf))))


QUERIES["digest_quality"] = _digest_quality
ORACLE["digest_quality"] = (
    "WITH fl AS (" + ORACLE["quality_flags"] + "), sc AS (" + ORACLE["overall_score"] + ") "
    "SELECT 'dirty' AS \"table\", (SELECT round(overall_score, 4) FROM sc) AS score, "
    "(SELECT string_agg(flag, '; ' ORDER BY flag) FROM fl) AS flags"
)


def _overview(spark, sf):
    tag = lambda df: df.withColumn("table", F.lit("dirty"))
    dirty = _dirty(spark, sf)
    return rounded(
        digest.digest_overview(
            tag(table_shape(dirty)), tag(logical_size(dirty)), tag(duplicate_rows(dirty)), tag(_scores(spark, sf)), tag(column_types(dirty))
        )
    )


QUERIES["digest_overview"] = _overview
ORACLE["digest_overview"] = (
    "WITH sc AS (" + ORACLE["overall_score"] + f"), p AS ({PLANTED_SQL}), d AS ({_DIRTY}) "
    "SELECT 'dirty' AS \"table\", count(*) AS \"rows\", 6 AS cols, "
    "round(CAST(count(*) * 28 + coalesce(sum(strlen(l_returnflag)), 0) + coalesce(sum(strlen(l_linestatus)), 0) AS DOUBLE) / (1024.0 * 1024.0), 6) AS logical_mb, "
    f"round({_DUPS} * 100.0 / CAST(count(*) AS DOUBLE), 6) AS duplicate_pct, (SELECT round(overall_score, 4) FROM sc) AS quality_score, "
    f"'{', '.join(_DIRTY_COLS)}' AS column_names FROM d"
)


def _rules(spark, sf):
    dirty = _dirty(spark, sf).withColumn("net_price", F.expr("cost - 50"))
    tag = lambda df: df.withColumn("table", F.lit("dirty"))
    return rounded(
        digest.issue_rules(tag(null_counts(dirty)), tag(numeric_profile(dirty)), tag(duplicate_rows(dirty)))
    )


_RULE_COLS = [*_DIRTY_COLS, "net_price"]
QUERIES["issue_rules"] = _rules
ORACLE["issue_rules"] = (
    f"WITH p AS ({PLANTED_SQL}), d AS (SELECT *, cost - 50 AS net_price FROM ({_DIRTY}) x), i AS ("
    + union_sql(
        [f"SELECT '{c}' AS \"column\", 'nulls' AS rule, (count(*) - count({c})) * 100.0 / CAST(count(*) AS DOUBLE) AS evidence, 0 AS least FROM d" for c in _RULE_COLS]
        + [
            f"SELECT '{c}', 'outliers', {_OUT}, 5 FROM (SELECT CAST({c} AS DOUBLE) AS x FROM d) v, ({fences_sql(c, 'd')}) f"
            for c in [*_DIRTY_NUMBERS, "net_price"]
        ]
        + [f"SELECT '__dataset__', 'duplicates', {_DUPS} * 100.0 / CAST((SELECT count(*) FROM d) AS DOUBLE), 1"]
    )
    + "), n AS (SELECT 'net_price' AS \"column\", 'negative values' AS rule, min(net_price) AS evidence FROM d) "
    "SELECT 'dirty' AS \"table\", \"column\", rule, round(evidence, 6) AS evidence FROM i WHERE evidence > least "
    "UNION ALL SELECT 'dirty', \"column\", rule, round(evidence, 6) FROM n WHERE evidence < 0"
)


def _bands(spark, sf):
    dirty = _dirty(spark, sf)
    scores = _scores(spark, sf).select(F.lit("score").alias("kind"), F.lit("overall").alias("name"), digest.score_band(F.col("overall_score")).alias("band"))
    pairs = pearson_pairs(dirty).select(
        F.lit("pair").alias("kind"), F.concat_ws("__", "col_a", "col_b").alias("name"), digest.strength_band(F.round("value", 4)).alias("band")
    )
    nulls = null_counts(dirty).select(F.lit("nulls").alias("kind"), F.col("column").alias("name"), digest.null_band(F.col("null_pct")).alias("band"))
    return union_all([scores, pairs, nulls])


QUERIES["score_bands"] = _bands
ORACLE["score_bands"] = (
    "WITH sc AS (" + ORACLE["overall_score"] + f"), p AS ({PLANTED_SQL}), d AS ({_DIRTY}), "
    f"k AS ({union_sql([_dirty_pair(a, b, i) for i, (a, b) in enumerate(_PAIRS)])}), "
    f"nl AS ({union_sql([f'SELECT {chr(39)}{c}{chr(39)} AS name, {pct} AS pct' for c, pct in _NULL_PCT.items()])}) "
    "SELECT 'score' AS kind, 'overall' AS name, CASE WHEN overall_score >= 0.9 THEN 'good' WHEN overall_score >= 0.7 THEN 'fair' ELSE 'poor' END AS band FROM sc "
    "UNION ALL SELECT 'pair', col_a || '__' || col_b, CASE WHEN abs(round(value, 4)) > 0.7 THEN 'strong' WHEN abs(round(value, 4)) > 0.4 THEN 'moderate' "
    "WHEN abs(round(value, 4)) > 0.2 THEN 'weak' ELSE 'none' END FROM k "
    "UNION ALL SELECT 'nulls', name, CASE WHEN pct > 10 THEN 'red' ELSE 'amber' END FROM nl WHERE pct > 0"
)
