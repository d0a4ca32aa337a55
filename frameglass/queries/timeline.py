"""Queries over datetime columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.temporal import (
    date_ranges,
    datetime_profile,
    day_table,
    detect_datetime,
    expected_step_gaps,
    gap_count,
    infer_frequencies,
    parse_datetimes,
    seasonality_hints,
    stamps_of,
)
from ..operators.tidy import union_all
from .common import Query, rounded, table, union_sql

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# --- detection and parsing ----------------------------------------------------------

_TEXTS = ["ts", "iso_text", "us_text", "mixed_text", "rare_text", "year_text", "event_type", "props", "value"]


def _texts(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "ts",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS iso_text",
        "date_format(ts, 'M/d/yyyy H:mm') AS us_text",
        "CASE WHEN event_type = 'view' THEN date_format(ts, 'M/d/yyyy') WHEN event_type = 'error' THEN "
        "date_format(ts, 'yyyy/M/d') WHEN event_type = 'click' AND value > 100 THEN 'soon' ELSE date_format(ts, 'yyyy-MM-dd') END AS mixed_text",
        "CASE WHEN event_type IN ('view', 'error') THEN event_type ELSE date_format(ts, 'yyyy-MM-dd') END AS rare_text",
        "CASE WHEN event_type = 'error' AND value > 200 THEN NULL ELSE CAST(year(ts) AS STRING) END AS year_text",
        "event_type",
        "props",
        "value",
    )


_TEXTS_SQL = (
    "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso_text, strftime(ts, '%-m/%-d/%Y %-H:%M') AS us_text, "
    "CASE WHEN event_type = 'view' THEN strftime(ts, '%-m/%-d/%Y') WHEN event_type = 'error' THEN strftime(ts, '%Y/%-m/%-d') "
    "WHEN event_type = 'click' AND value > 100 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS mixed_text, "
    "CASE WHEN event_type IN ('view', 'error') THEN event_type ELSE strftime(ts, '%Y-%m-%d') END AS rare_text, "
    "CASE WHEN event_type = 'error' AND value > 200 THEN NULL ELSE CAST(year(ts) AS VARCHAR) END AS year_text, event_type, props FROM events"
)
_FORMATS_SQL = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%m/%d/%Y %H:%M', '%m/%d/%Y', '%Y/%m/%d', '%Y']"


def _share_sql(c: str) -> str:
    hit = f"count(try_strptime({c}, {_FORMATS_SQL}))"
    return f"SELECT '{c}' AS \"column\", round({hit} / CAST(count(*) AS DOUBLE), 6) AS parsed_share FROM s"


QUERIES["detect_datetime"] = lambda spark, sf: rounded(detect_datetime(_texts(spark, sf)))
ORACLE["detect_datetime"] = (
    f'WITH s AS ({_TEXTS_SQL}), d AS (SELECT \'ts\' AS "column", CAST(1 AS DOUBLE) AS parsed_share UNION ALL '
    f"SELECT 'value', 0 UNION ALL {union_sql([_share_sql(c) for c in _TEXTS[1:-1]])}) "
    'SELECT "column", parsed_share, parsed_share >= 0.8 AS is_datetime FROM d'
)


def _parse(spark, sf):
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderstatus = 'P' THEN date_format(o_orderdate, 'M/d/yyyy') WHEN o_totalprice > 450000 THEN 'later' "
        "ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS placed",
    )
    return parse_datetimes(orders, ["placed"]).selectExpr(
        "o_orderkey", "date_format(placed, 'yyyy-MM-dd HH:mm:ss') AS placed"
    )


QUERIES["parse_datetime"] = _parse
ORACLE["parse_datetime"] = (
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_totalprice > 450000 THEN NULL "
    "ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS placed FROM orders"
)

_ISO_SECOND = "yyyy-MM-dd''T''HH:mm:ss"


def _parse_zoned(spark, sf):
    """Instants written with `Z` or an offset."""
    text = (
        f"CASE WHEN event_type = 'view' THEN concat(date_format(ts, '{_ISO_SECOND}'), 'Z') "
        f"ELSE concat(date_format(ts + INTERVAL 2 HOURS, '{_ISO_SECOND}'), '+02:00') END AS written"
    ).replace("''T''", "\\'T\\'")
    events = table(spark, sf, "events").selectExpr("event_id", text)
    return parse_datetimes(events, ["written"]).selectExpr(
        "event_id", "date_format(to_utc_timestamp(written, current_timezone()), 'yyyy-MM-dd HH:mm:ss') AS instant"
    )


QUERIES["parse_zoned_texts"] = _parse_zoned
ORACLE["parse_zoned_texts"] = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS instant FROM events"


def _local_days(spark, sf):
    """Midnights of a zone with summer time, as instants, profiled in that zone."""
    zone, kept = "America/New_York", spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        days = table(spark, sf, "events").selectExpr("CAST(CAST(date_trunc('day', CAST(ts AS TIMESTAMP_NTZ)) AS TIMESTAMP_NTZ) AS TIMESTAMP) AS day")
        profiled = datetime_profile(days.distinct(), ["day"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)
    return profiled.select("column", "min_date", "max_date", "inferred_freq", "gaps_count", "timezone")


QUERIES["zoned_days"] = _local_days
ORACLE["zoned_days"] = (
    "SELECT 'day' AS \"column\", strftime(min(ts), '%Y-%m-%d') AS min_date, strftime(max(ts), '%Y-%m-%d') AS max_date, "
    "'D' AS inferred_freq, 0::BIGINT AS gaps_count, 'America/New_York' AS timezone FROM events"
)

# --- range, frequency, gaps, seasonality --------------------------------------------

# Regular series derived from whole tables: (name, Spark text, reference text).
_SERIES = {
    "raw events": "SELECT ts FROM {events}",
    "raw shipments": "SELECT l_shipdate AS ts FROM {lineitem}",
    "days": "SELECT DISTINCT date_trunc('day', ts) AS ts FROM {events}",
    "hours": "SELECT DISTINCT date_trunc('hour', ts) AS ts FROM {events}",
    "weeks": "SELECT DISTINCT date_trunc('week', o_orderdate) AS ts FROM {orders}",
    "month starts": "SELECT DISTINCT date_trunc('month', l_shipdate) AS ts FROM {lineitem}",
    "month ends": "SELECT DISTINCT CAST(last_day(l_shipdate) AS {stamp}) AS ts FROM {lineitem}",
    "quarters": "SELECT DISTINCT date_trunc('quarter', o_orderdate) AS ts FROM {orders}",
    "years": "SELECT DISTINCT date_trunc('year', o_orderdate) AS ts FROM {orders}",
    "working days": "SELECT DISTINCT l_shipdate AS ts FROM {lineitem} WHERE {weekday} <= 5",
    "first Mondays": "SELECT DISTINCT l_shipdate AS ts FROM {lineitem} WHERE {weekday} = 1 AND day(l_shipdate) <= 7 "
    "AND month(l_shipdate) NOT IN (3, 7)",
}


def _series(spark, sf, name):
    text = _SERIES[name].replace("{stamp}", "TIMESTAMP_NTZ").replace("{weekday}", "(weekday(l_shipdate) + 1)")
    used = {t: table(spark, sf, t) for t in ("events", "lineitem", "orders") if "{" + t + "}" in text}
    # Spark truncates to a zoned stamp; the session zone is undone by the cast back.
    return spark.sql(text, **used).select(F.col("ts").cast("timestamp_ntz").alias(name))


_ALL_SQL = union_sql(
    [
        f"SELECT '{name}' AS \"column\", CAST(ts AS TIMESTAMP) AS ts FROM ("
        + text.format(events="events", lineitem="lineitem", orders="orders", stamp="TIMESTAMP", weekday="isodow(l_shipdate)")
        + ") s"
        for name, text in _SERIES.items()
    ]
)
_FACTS_SQL = (
    f"WITH s AS ({_ALL_SQL}), l AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS d, "
    "year(ts) * 12 + month(ts) - lag(year(ts) * 12 + month(ts)) OVER w AS md FROM s WINDOW w AS (PARTITION BY \"column\" ORDER BY ts)), "
    'f AS (SELECT "column", count(*) AS n, count(DISTINCT ts) AS nd, min(ts) AS lo, max(ts) AS hi, min(d) AS d0, max(d) AS d1, '
    "count(DISTINCT d) AS dk, min(md) AS m0, count(DISTINCT md) AS mk, bool_and(day(ts) = 1) AS cs, "
    "bool_and(CAST(ts AS DATE) = last_day(ts)) AS ce, min(isodow(ts)) AS w0, max(isodow(ts)) AS w1, "
    "bool_and(d IS NULL OR (isodow(ts) = 1) = (d = 259200000000)) AS mondays, "
    "count(DISTINCT (day(ts) - 1) // 7) AS wk, min((day(ts) - 1) // 7) AS wk0 FROM l GROUP BY 1), "
    "lab AS (SELECT *, CASE WHEN n < 3 OR n <> nd THEN NULL "
    "WHEN d0 % 86400000000 = 0 AND mk = 1 AND m0 % 12 = 0 AND cs THEN 'YS-JAN' "
    "WHEN d0 % 86400000000 = 0 AND mk = 1 AND m0 % 3 = 0 AND cs THEN 'QS-OCT' "
    "WHEN d0 % 86400000000 = 0 AND mk = 1 AND ce THEN 'ME' WHEN d0 % 86400000000 = 0 AND mk = 1 AND cs THEN 'MS' "
    "WHEN dk = 1 AND d0 = 604800000000 THEN 'W-MON' WHEN dk = 1 AND d0 = 86400000000 THEN 'D' WHEN dk = 1 AND d0 = 3600000000 THEN 'h' "
    "WHEN dk = 2 AND d0 = 86400000000 AND d1 = 259200000000 AND w1 <= 5 AND mondays THEN 'B' "
    "WHEN d0 % 86400000000 = 0 AND w0 = w1 AND wk = 1 AND wk0 < 4 THEN 'WOM-' || (wk0 + 1) || 'MON' END AS inferred_freq FROM f) "
)


def _stamps(spark, sf):
    return union_all([stamps_of(_series(spark, sf, name), [name]) for name in _SERIES])


QUERIES["date_range"] = lambda spark, sf: date_ranges(day_table(_stamps(spark, sf))).drop("min_u", "max_u")
ORACLE["date_range"] = _FACTS_SQL + (
    'SELECT "column", n, epoch_us(lo) AS min_us, epoch_us(hi) AS max_us, (epoch_us(hi) - epoch_us(lo)) // 86400000000 AS date_range_days FROM f'
)


def _labels(spark, sf):
    """Ranges and labels of all series; the day table holds at most one row per day and series."""
    stamps = _stamps(spark, sf)
    days = day_table(stamps).persist()
    try:
        ranges = date_ranges(days)
        return ranges.collect(), infer_frequencies(stamps, days, ranges)
    finally:
        days.unpersist()


QUERIES["infer_frequency"] = lambda spark, sf: spark.createDataFrame(
    [(name, labels.get(name)) for labels in [_labels(spark, sf)[1]] for name in _SERIES],
    "column string, inferred_freq string",
)
ORACLE["infer_frequency"] = _FACTS_SQL + 'SELECT "column", inferred_freq FROM lab'


def _gaps(spark, sf):
    ranges, labels = _labels(spark, sf)
    rows = [(r["column"], gap_count(labels.get(r["column"]), r["n"], r["min_us"], r["max_us"])) for r in ranges]
    return spark.createDataFrame(rows, "column string, gaps_count bigint")


QUERIES["gap_count"] = _gaps
ORACLE["gap_count"] = _FACTS_SQL + (
    'SELECT "column", CASE WHEN inferred_freq LIKE \'WOM%\' THEN (year(hi) - year(lo)) * 12 + month(hi) - month(lo) + 1 - n '
    'WHEN inferred_freq IS NOT NULL THEN 0 END AS gaps_count FROM lab'
)

QUERIES["expected_step_gaps"] = lambda spark, sf: expected_step_gaps(
    table(spark, sf, "events").selectExpr("CAST(date_trunc('minute', ts) AS TIMESTAMP_NTZ) AS minute"), "minute", 60_000_000
)
ORACLE["expected_step_gaps"] = (
    "WITH m AS (SELECT DISTINCT epoch_us(date_trunc('minute', ts)) AS m FROM events), "
    "e AS (SELECT (max(m) - min(m)) // 60000000 + 1 AS expected, count(*) AS present FROM m) "
    "SELECT 'minute' AS \"column\", expected, present, expected - present AS gaps FROM e"
)

QUERIES["seasonality_hint"] = lambda spark, sf: seasonality_hints(day_table(_stamps(spark, sf)))
ORACLE["seasonality_hint"] = _FACTS_SQL + (
    ', g AS (SELECT "column", d // 86400000000 AS g, count(*) AS c FROM l WHERE d IS NOT NULL GROUP BY 1, 2), '
    'h AS (SELECT "column", g, row_number() OVER (PARTITION BY "column" ORDER BY c DESC, g) AS r FROM g) '
    'SELECT f."column", CASE WHEN n < 10 THEN \'unknown\' WHEN g = 1 THEN \'daily\' WHEN g = 7 THEN \'weekly\' '
    "WHEN g BETWEEN 28 AND 31 THEN 'monthly' ELSE 'unknown' END AS seasonality_hint FROM f JOIN h ON f.\"column\" = h.\"column\" AND h.r = 1"
)


def _profile(spark, sf):
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderpriority", "o_orderdate", "date_format(o_orderdate, 'M/d/yyyy') AS placed"
    )
    return datetime_profile(orders)


QUERIES["datetime_profile"] = _profile


def season_sql(series: str) -> str:
    """Reference SQL: the hint for the stamps `ts` of a query, as a scalar."""
    return (
        "(SELECT CASE WHEN sum(c) < 9 THEN 'unknown' ELSE max(CASE WHEN r = 1 THEN CASE WHEN g = 1 THEN 'daily' WHEN g = 7 THEN 'weekly' "
        "WHEN g BETWEEN 28 AND 31 THEN 'monthly' ELSE 'unknown' END END) END FROM (SELECT g, c, row_number() OVER (ORDER BY c DESC, g) AS r "
        "FROM (SELECT (epoch_us(ts) - b) // 86400000000 AS g, count(*) AS c FROM (SELECT ts, lag(epoch_us(ts)) OVER (ORDER BY ts) AS b "
        f"FROM ({series}) q) w WHERE b IS NOT NULL GROUP BY 1) v) u)"
    )


ORACLE["datetime_profile"] = (
    "WITH p AS (SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS min_date, strftime(max(o_orderdate), '%Y-%m-%d') AS max_date, "
    "(epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) // 86400000000 AS date_range_days FROM orders) "
    + union_sql(
        [
            f"SELECT '{c}' AS \"column\", min_date, max_date, date_range_days, CAST(NULL AS VARCHAR) AS inferred_freq, "
            f"CAST(NULL AS BIGINT) AS gaps_count, {season_sql('SELECT o_orderdate AS ts FROM orders')} AS seasonality_hint, 'naive' AS timezone FROM p"
            for c in ("o_orderdate", "placed")
        ]
    )
)
