"""Datetime columns: detection, parsing, range, frequency, gaps and seasonality.

Nothing here sorts raw rows. A per-day table (its size bounded by the calendar)
carries everything that needs the order of timestamps, and regularity is proved by
arithmetic: n distinct stamps that are all multiples of (max - min) / (n - 1) away
from the first one are a full grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sql
from ..functions.kinds import categorical_columns, datetime_columns
from .tidy import per_column

DETECT_SHARE = 0.8
FOUR_DIGITS = r"\d{4}"
DAY = 86_400_000_000
HOUR = 3_600_000_000

ISO = ""  # read by a plain cast
ZONED = "zoned"  # an instant, read by a plain cast

# Accepted date texts as (full-match pattern, Spark format), month first.
FORMATS = (
    (r"\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}:\d{2}(\.\d{1,6})?", ISO),
    (r"\d{4}-\d{2}-\d{2}", ISO),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}", "M/d/yyyy H:mm"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}", "M/d/yyyy H:mm:ss"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?", ISO),
    (r"\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}", "yyyy-MM-dd H:mm"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{1,2} [A-Z][a-z]{2} \d{4}", "d MMM yyyy"),
    (r"[A-Z][a-z]{2} \d{1,2}, \d{4}", "MMM d, yyyy"),
    (r"(1[89]|20|21)\d{6}", "yyyyMMdd"),
    (r"(1[789]|20|21)\d{2}", "yyyy"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})", ZONED),
    (r"[A-Z][a-z]{3,8} \d{1,2}, \d{4}", "MMMM d, yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"),
    (r"\d{4}-\d{2}-\d{2} \d{1,2}:\d{2} [AP]M", "yyyy-MM-dd h:mm a"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AP]M", "M/d/yyyy h:mm a"),
)


def _parse(x: str, index: int) -> str:
    """The text in one format; the pattern gate keeps the costly parse off other texts."""
    pattern, fmt = FORMATS[index]
    hit = f"CASE WHEN {x} RLIKE {sql.text(f'^({pattern})$')} THEN {x} END"
    if fmt == ZONED:
        return f"try_cast({hit} AS TIMESTAMP)"
    if fmt == ISO:
        return f"try_cast({hit} AS TIMESTAMP_NTZ)"
    return f"CAST(try_to_timestamp({hit}, {sql.text(fmt)}) AS TIMESTAMP_NTZ)"


def _parses(x: str) -> str:
    """Whether any format reads the text. All formats have a 4-digit run."""
    any_format = " OR ".join(f"{_parse(x, i)} IS NOT NULL" for i in range(len(FORMATS)))
    return f"CASE WHEN {x} RLIKE {sql.text(FOUR_DIGITS)} THEN {any_format} ELSE FALSE END"


def detect_datetime(df: DataFrame, threshold: float = DETECT_SHARE) -> DataFrame:
    """(column, parsed_share, is_datetime): typed columns, or texts of which 80 % of all rows parse."""
    texts, typed = set(categorical_columns(df)), set(datetime_columns(df))

    def share(c: str, x: str) -> dict[str, str]:
        if c in texts:
            return {"parsed_share": f"coalesce(try_divide(count_if({_parses(x)}), count(1)), 0.0D)"}
        return {"parsed_share": f"coalesce(max({1.0 if c in typed else 0.0}D), 0.0D)"}

    return per_column(df, df.columns, share).selectExpr(
        "column", "parsed_share", f"parsed_share >= {threshold} AS is_datetime"
    )


def detected_columns(df: DataFrame, threshold: float = DETECT_SHARE) -> list[str]:
    hits = {r["column"] for r in detect_datetime(df, threshold).where("is_datetime").collect()}
    return [c for c in df.columns if c in hits]


def choose_formats(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Per text column, the index of the one format that reads most rows."""
    if not cols:
        return {}
    hits = lambda c, x: {
        "hits": f"array({', '.join(f'count({_parse(x, i)})' for i in range(len(FORMATS)))})"
    }
    rows = per_column(df, cols, hits).collect()
    return {r["column"]: max(range(len(FORMATS)), key=lambda i: (r["hits"][i], -i)) for r in rows}


def parse_datetimes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """`df` with the text columns of `cols` read by their main format; other texts become null."""
    texts = [c for c in cols if c in set(categorical_columns(df))]
    chosen = choose_formats(df, texts)
    return df.withColumns({c: F.expr(_parse(sql.quoted(c), i)) for c, i in chosen.items()}) if chosen else df


def micros(x: str, dtype: T.DataType) -> str:
    """Microseconds since 1970 of the wall time; zoned stamps are read in the session's zone."""
    if isinstance(dtype, T.TimestampType):
        x = f"CAST({x} AS TIMESTAMP_NTZ)"
    days = f"CAST(unix_date(CAST({x} AS DATE)) AS BIGINT) * {DAY}L"
    if isinstance(dtype, T.DateType):
        return days
    seconds = f"CAST(extract(SECOND FROM {x}) * 1000000 AS BIGINT)"
    return f"{days} + hour({x}) * {HOUR}L + minute({x}) * 60000000L + {seconds}"


def whole_days(us: str) -> str:
    """Whole days in a span of microseconds, rounded down."""
    return f"(({us}) - pmod({us}, {DAY}L)) div {DAY}L"


def elapsed(x: str, dtype: T.DataType) -> str:
    """Microseconds since 1970 as they pass; the wall time of zone-less stamps."""
    return f"unix_micros({x})" if isinstance(dtype, T.TimestampType) else micros(x, dtype)


def stamps_of(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, m, u): the non-null stamps of all columns in microseconds of wall time and of elapsed time.

    Days and calendar rules follow the wall time; spans, gaps and steps inside days the time that passes.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    cells = [
        sql.struct({"column": sql.text(c), "m": micros(sql.quoted(c), kinds[c]), "u": elapsed(sql.quoted(c), kinds[c])})
        for c in cols
    ]
    return df.selectExpr(sql.rows(cells)).where("m IS NOT NULL")


def day_table(stamps: DataFrame) -> DataFrame:
    """(column, day, first, last, cnt): at most one row per calendar day and column."""
    return stamps.groupBy("column", F.expr(whole_days("m")).alias("day")).agg(
        F.min("m").alias("first"), F.max("m").alias("last"), F.count(F.lit(1)).alias("cnt"),
        F.min("u").alias("first_u"), F.max("u").alias("last_u"),
    )


def date_ranges(days: DataFrame) -> DataFrame:
    """(column, n, min_us, max_us, min_u, max_u, date_range_days) from the day table; elapsed whole days."""
    return days.groupBy("column").agg(
        F.sum("cnt").alias("n"),
        F.min("first").alias("min_us"),
        F.max("last").alias("max_us"),
        F.min("first_u").alias("min_u"),
        F.max("last_u").alias("max_u"),
        F.expr(whole_days("max(last_u) - min(first_u)")).alias("date_range_days"),
    )


def day_gaps(days: DataFrame) -> DataFrame:
    """(column, gap_days, cnt): whole days between consecutive sorted stamps.

    Stamps of one day lie less than a day apart, so only the step from the last
    stamp of a day to the first of the next present day can span whole days.
    """
    # The window sorts calendar days, never raw rows.
    before = F.lag("last_u").over(Window.partitionBy("column").orderBy("day"))
    step = days.withColumn("before", before)
    across = step.where("before IS NOT NULL").selectExpr(
        "column", f"{whole_days('first_u - before')} AS gap_days", "1L AS cnt"
    )
    within = days.where("cnt > 1").selectExpr("column", "0L AS gap_days", "cnt - 1 AS cnt")
    return across.unionByName(within).groupBy("column", "gap_days").agg(F.sum("cnt").alias("cnt"))


def seasonality_hints(days: DataFrame) -> DataFrame:
    """(column, seasonality_hint) from the most common gap; ties to the smaller gap."""
    gaps = day_gaps(days)
    best = gaps.groupBy("column").agg(
        F.expr("min_by(gap_days, struct(-cnt, gap_days))").alias("gap"), F.sum("cnt").alias("steps")
    )
    hint = (
        "CASE WHEN steps < 9 THEN 'unknown' WHEN gap = 1 THEN 'daily' WHEN gap = 7 THEN 'weekly' "
        "WHEN gap BETWEEN 28 AND 31 THEN 'monthly' ELSE 'unknown' END"
    )
    columns = days.select("column").distinct()
    return columns.join(F.broadcast(best), "column", "left").selectExpr(
        "column", f"coalesce({hint}, 'unknown') AS seasonality_hint"
    )


_EPOCH = datetime(1970, 1, 1)
_WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def stamp(us: int) -> datetime:
    return _EPOCH + timedelta(microseconds=us)


def _counted(label: str, step: int) -> str:
    return label if step == 1 else f"{step}{label}"


def _month_number(date: str) -> str:
    return f"(year({date}) * 12 + month({date}) - 1)"


def _spans(ranges: DataFrame) -> DataFrame:
    """Per column the only step, in time and in months, at which n stamps can fill the span."""
    day_of = lambda us: f"date_from_unix_date(CAST({whole_days(us)} AS INT))"
    first, last = _month_number(day_of("min_us")), _month_number(day_of("max_us"))
    exact = lambda span: f"CASE WHEN ({span}) % (n - 1) = 0 AND {span} > 0 THEN ({span}) div (n - 1) END"
    return ranges.where("n >= 3 AND max_us > min_us").selectExpr(
        "column", "n", "min_us", "max_us", "min_u",
        f"{exact('(max_us - min_us)')} AS step",
        f"{exact('(max_u - min_u)')} AS step_u",
        f"{first} AS first_month",
        f"{exact(f'({last} - {first})')} AS month_step",
    )


def calendar_facts(days: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row per column of aggregates over its days that decide every calendar rule.

    `ranges` holds one row per column, so it is small enough to broadcast. For stamps
    inside days the first and last stamp of each day give necessary conditions.
    """
    at = lambda end, step: f"({end} - min_us) % {step} = 0"
    both = lambda step: f"coalesce({at('first', step)} AND {at('last', step)}, FALSE)"
    passing = "coalesce((first_u - min_u) % step_u = 0 AND (last_u - min_u) % step_u = 0, FALSE)"
    return (
        days.join(F.broadcast(_spans(ranges)), "column")
        .selectExpr("*", "date_from_unix_date(CAST(day AS INT)) AS date")
        .selectExpr(
            "*",
            "day(date) AS dom",
            "weekday(date) AS wd",
            f"{_month_number('date')} AS month",
            "day(last_day(date)) - day(date) AS from_end",
        )
        .groupBy("column", "n", "min_us", "max_us", "step", "step_u", "month_step")
        .agg(
            *map(
                F.expr,
                (
                    f"bool_and(first = last AND {at('first', f'{DAY}L')}) AS whole_days",
                    "max(cnt) AS most_a_day",
                    f"bool_and({both('step')}) AS maybe_grid",
                    f"bool_and({passing}) AS maybe_passing",
                    f"bool_and({both(f'{HOUR}L')}) AS maybe_hours",
                    "min(wd) AS weekday_lo",
                    "max(wd) AS weekday_hi",
                    "array_sort(collect_set((dom - 1) div 7)) AS weeks",
                    "bool_and(dom = 1) AS cs",
                    "bool_and(dom = 1 OR (dom <= 3 AND wd = 0)) AS bs",
                    "bool_and(from_end = 0) AS ce",
                    "bool_and(from_end = 0 OR (from_end < 3 AND wd = 4)) AS be",
                    "bool_and(coalesce((month - first_month) % month_step = 0, FALSE)) AS on_month_grid",
                    "count(DISTINCT month) AS months",
                ),
            )
        )
    )


def _intraday_facts(stamps: DataFrame, ranges: DataFrame) -> DataFrame:
    """(column, repeats, on_grid, on_passing_grid, whole_hours) over all stamps of the few columns that may be regular."""
    offset = lambda step: f"bool_and(coalesce((m - min_us) % {step} = 0, FALSE))"
    return (
        stamps.groupBy("column", "m", "u")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .join(F.broadcast(_spans(ranges)), "column")
        .groupBy("column")
        .agg(
            F.expr("bool_or(cnt > 1) AS repeats"),
            F.expr(f"{offset('step')} AS on_grid"),
            F.expr("bool_and(coalesce((u - min_u) % step_u = 0, FALSE)) AS on_passing_grid"),
            F.expr(f"{offset(f'{HOUR}L')} AS whole_hours"),
        )
    )


def _calendar_label(fact: Row) -> str | None:
    """Year, quarter and month rules: one stamp per period, at its start or end."""
    if not fact["on_month_grid"] or fact["months"] != fact["n"]:
        return None
    place = next((k for k in ("ce", "be", "cs", "bs") if fact[k]), None)
    if place is None:
        return None
    prefix, suffix = ("B" if place[0] == "b" else ""), ("S" if place[1] == "s" else "E")
    step, month = fact["month_step"], stamp(fact["min_us"]).month
    if step % 12 == 0:
        return _counted(f"{prefix}Y{suffix}-{_MONTHS[month - 1]}", step // 12)
    if step % 3 == 0:
        anchor = (month - 1) % 3 + 10  # the quarter cycle is named by its month of Oct-Dec
        return _counted(f"{prefix}Q{suffix}-{_MONTHS[anchor - 1]}", step // 3)
    return _counted(f"{prefix}M{suffix}", step)


def _step_label(step: int, at: datetime) -> str:
    if step % DAY == 0:
        days = step // DAY
        if days % 7 == 0:
            return _counted(f"W-{_WEEKDAYS[at.weekday()]}", days // 7)
        return _counted("D", days)
    for size, unit in ((HOUR, "h"), (60_000_000, "min"), (1_000_000, "s"), (1_000, "ms"), (1, "us")):
        if step % size == 0:
            return _counted(unit, step // size)
    raise AssertionError("one microsecond divides every step")


def _day_rule(fact: Row) -> str | None:
    """Label of whole-day series that are not a plain grid."""
    first, last = stamp(fact["min_us"]), stamp(fact["max_us"])
    weekdays = np.busday_count(first.date(), np.datetime64(last.date(), "D") + 1)  # both ends count
    if fact["weekday_hi"] <= 4 and weekdays == fact["n"]:
        return "B"
    if fact["weekday_lo"] == fact["weekday_hi"]:
        weeks = [w for w in fact["weeks"] if w < 4]
        if len(weeks) == 1:
            return f"WOM-{weeks[0] + 1}{_WEEKDAYS[first.weekday()]}"
    return None


def _is_business_hours(stamps: DataFrame, column: str) -> bool:
    """Steps of 1 h inside a day and 17 h or 65 h over a night or weekend, nothing else.

    Only reached when all stamps are whole hours apart: at most 24 a calendar day.
    """
    hours = stamps.where(F.col("column") == column).select("m").distinct()
    steps = hours.selectExpr(f"(m - lag(m) OVER (ORDER BY m)) div {HOUR}L AS h").where("h IS NOT NULL")
    return sorted(r["h"] for r in steps.distinct().limit(4).collect()) in ([1, 17], [1, 65], [1, 17, 65])


def _whole_day_label(fact: Row) -> str | None:
    if fact["most_a_day"] > 1:
        return None
    label = _calendar_label(fact)
    if label is None and fact["maybe_grid"]:
        label = _step_label(fact["step"], stamp(fact["min_us"]))
    return label or _day_rule(fact)


def infer_frequencies(stamps: DataFrame, days: DataFrame, ranges: DataFrame) -> dict[str, str]:
    """{column: frequency label}; a column without one is left out.

    No label below 3 stamps, on repeats and on irregular steps. Everything is decided
    on the day table; the stamps themselves are only read for columns whose first and
    last stamp of every day fit a regular step inside the day.
    """
    facts = {r["column"]: r for r in calendar_facts(days, ranges).collect()}
    found = {c: _whole_day_label(f) for c, f in facts.items() if f["whole_days"]}
    inside = [
        c
        for c, f in facts.items()
        if not f["whole_days"] and (f["maybe_grid"] or f["maybe_passing"] or f["maybe_hours"])
    ]
    if inside:
        of_inside = F.col("column").isin(inside)
        for row in _intraday_facts(stamps.where(of_inside), ranges.where(of_inside)).collect():
            c, fact = row["column"], facts[row["column"]]
            if row["repeats"]:
                continue
            if row["on_grid"] and fact["step"] % DAY == 0:
                found[c] = _step_label(fact["step"], stamp(fact["min_us"]))
            elif row["on_passing_grid"]:
                found[c] = _step_label(fact["step_u"], stamp(fact["min_us"]))
            elif row["whole_hours"] and _is_business_hours(stamps, c):
                found[c] = "bh"
    return {c: label for c, label in found.items() if label}


def calendar_length(label: str, lo: int, hi: int) -> int:
    """Stamps a full calendar of this frequency has between two stamps that lie on it."""
    first, last = stamp(lo), stamp(hi)
    if label.startswith("WOM"):
        return (last.year - first.year) * 12 + last.month - first.month + 1
    return len(pd.date_range(first, last, freq=label))


def gap_count(label: str | None, n: int, lo: int, hi: int) -> int | None:
    """Missing stamps; all labels but the skippable ones are full by construction."""
    if label is None:
        return None
    return calendar_length(label, lo, hi) - n if label.startswith("WOM") or label == "bh" else 0


def expected_step_gaps(df: DataFrame, column: str, step_us: int) -> DataFrame:
    """(column, expected, present, gaps) of a series that should have a fixed step.

    Extension for irregular series, where no frequency can be inferred.
    """
    stamps = stamps_of(df, [column]).distinct()
    return stamps.groupBy("column").agg(
        F.expr(f"(max(m) - min(m)) div {step_us}L + 1").alias("expected"),
        F.count(F.lit(1)).alias("present"),
    ).withColumn("gaps", F.expr("greatest(expected - present, 0L)"))


SPAN_SCHEMA = "column string, n bigint, min_us bigint, max_us bigint, min_u bigint, max_u bigint"
PROFILE_SCHEMA = (
    "column string, min_date string, max_date string, date_range_days bigint, inferred_freq string, "
    "gaps_count bigint, seasonality_hint string, timezone string"
)


def datetime_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per detected datetime column that holds a stamp (`PROFILE_SCHEMA`)."""
    spark = df.sparkSession
    cols = detected_columns(df) if cols is None else list(cols)
    if not cols:
        return spark.createDataFrame([], PROFILE_SCHEMA)
    parsed = parse_datetimes(df, cols)
    zones = {f.name: isinstance(f.dataType, T.TimestampType) for f in parsed.schema}
    stamps = stamps_of(parsed, cols)
    days = day_table(stamps).persist()
    try:
        known = date_ranges(days).join(seasonality_hints(days), "column").collect()
        ranges = {r["column"]: r for r in known}
        spans = [(c, *(r[k] for k in ("n", "min_us", "max_us", "min_u", "max_u"))) for c, r in ranges.items()]
        labels = infer_frequencies(stamps, days, spark.createDataFrame(spans, SPAN_SCHEMA)) if spans else {}
    finally:
        days.unpersist()
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = [
        (
            c,
            str(stamp(r["min_us"]).date()),
            str(stamp(r["max_us"]).date()),
            r["date_range_days"],
            labels.get(c),
            gap_count(labels.get(c), r["n"], r["min_us"], r["max_us"]),
            r["seasonality_hint"],
            zone if zones[c] else "naive",
        )
        for c in cols
        if (r := ranges.get(c))
    ]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)
