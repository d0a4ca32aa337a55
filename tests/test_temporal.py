"""Datetime operators against the labels pandas gives."""

import pandas as pd
import pytest

from frameglass.operators.temporal import (
    datetime_profile,
    detect_datetime,
    expected_step_gaps,
    parse_datetimes,
)
from frameglass.operators.quality import quality_flags, timeliness
from frameglass.operators.duplicates import duplicate_rows
from frameglass.operators.schema import null_counts

FREQS = ["D", "2D", "B", "h", "15min", "6h", "s", "W-MON", "2W-WED", "MS", "ME", "BMS", "BME", "2MS", "QS-OCT", "QE-DEC",
         "YS-JAN", "YE-DEC", "YS-MAR", "2YS-JAN", "WOM-1MON", "WOM-3FRI", "bh"]


def stamps(spark, values):
    rows = [(pd.Timestamp(v).to_pydatetime(),) for v in values]
    return spark.createDataFrame(rows, "t timestamp_ntz")


def one(spark, values):
    return datetime_profile(stamps(spark, values), ["t"]).first()


@pytest.mark.parametrize("freq", FREQS)
def test_frequency_like_pandas(spark, freq):
    series = pd.date_range("2021-01-04 09:00" if freq == "bh" else "2021-01-01", periods=36, freq=freq)
    expected = pd.infer_freq(series)
    got = one(spark, reversed(series))
    assert got["inferred_freq"] == expected
    assert got["gaps_count"] == (None if expected is None else 0)


def test_no_frequency_on_repeat_gap_or_few(spark):
    days = list(pd.date_range("2024-01-01", periods=20))
    assert one(spark, days + days[:1])["inferred_freq"] is None
    assert one(spark, days[:7] + days[8:])["inferred_freq"] is None
    assert one(spark, days[:2])["inferred_freq"] is None
    assert one(spark, days[:1] * 5)["inferred_freq"] is None


def test_skipped_month_is_a_gap(spark):
    mondays = list(pd.date_range("2021-01-01", periods=12, freq="WOM-1MON"))
    series = mondays[:5] + mondays[6:]
    assert pd.infer_freq(pd.DatetimeIndex(series)) == "WOM-1MON"
    df = stamps(spark, series)
    got = datetime_profile(df, ["t"])
    assert got.first()["gaps_count"] == 1
    days = got.first()["date_range_days"]
    assert abs(timeliness(got).first()[0] - (1 - 1 / days)) < 1e-12
    assert [r["flag"] for r in quality_flags(null_counts(df), duplicate_rows(df), got).collect()] == ["1 datetime gaps in 't'"]


@pytest.mark.parametrize("freq, hint", [("D", "daily"), ("W-SUN", "weekly"), ("MS", "monthly"), ("3D", "unknown"), ("h", "unknown")])
def test_seasonality(spark, freq, hint):
    assert one(spark, pd.date_range("2023-01-01", periods=24, freq=freq))["seasonality_hint"] == hint
    assert one(spark, pd.date_range("2023-01-01", periods=9, freq=freq))["seasonality_hint"] == "unknown"


def test_elapsed_days_not_calendar_days(spark):
    got = one(spark, ["2024-01-01 23:00", "2024-01-03 01:00"])
    assert got["date_range_days"] == 1 and got["timezone"] == "naive"


def test_before_1970(spark):
    got = one(spark, pd.date_range("1900-01-01", periods=12, freq="MS"))
    assert got["inferred_freq"] == "MS" and got["min_date"] == "1900-01-01"


@pytest.mark.parametrize("good, hit", [(80, True), (79, False)])
def test_detection_threshold_counts_nulls(spark, good, hit):
    texts = ["2024-01-02", "1/2/2024 3:04", "1/2/2024", "2024-01-02T03:04:05", "2024-01-02 03:04:05.5", "2024"]
    values = [texts[i % len(texts)] for i in range(good)] + [None if i % 2 else "536365" for i in range(100 - good)]
    df = spark.createDataFrame([(v,) for v in values], "d string")
    assert detect_datetime(df).first()["is_datetime"] is hit


def test_codes_are_not_dates(spark):
    df = spark.createDataFrame([("85123A", "12", True, 3)] * 3, "a string, b string, c boolean, d int")
    assert detect_datetime(df).where("is_datetime").count() == 0


def test_main_format_wins(spark):
    df = spark.createDataFrame([("1/2/2024",), ("2024-03-04",), ("2024-03-05",)], "d string")
    assert [r[0] and str(r[0].date()) for r in parse_datetimes(df, ["d"]).collect()] == [None, "2024-03-04", "2024-03-05"]


def test_expected_step(spark):
    days = list(pd.date_range("2024-01-01", periods=10))
    got = expected_step_gaps(stamps(spark, days[:4] + days[6:]), "t", 86_400_000_000).first()
    assert (got["expected"], got["present"], got["gaps"]) == (10, 8, 2)


def zoned(spark, zone, texts):
    kept = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in texts], "s string").selectExpr("timestamp(s) AS t")
        return datetime_profile(df, ["t"]).collect()[0].asDict()
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)


def test_zoned_stamps_follow_local_days(spark):
    tokyo = zoned(spark, "Asia/Tokyo", [f"2024-{m:02d}-01 00:00:00" for m in range(1, 13)])
    assert (tokyo["min_date"], tokyo["inferred_freq"], tokyo["timezone"]) == ("2024-01-01", "MS", "Asia/Tokyo")
    days = [str(d.date()) for d in pd.date_range("2024-01-01", "2024-12-31")]
    assert zoned(spark, "America/New_York", days)["inferred_freq"] == "D"
    hours = [str(h)[:19] + "+00:00" for h in pd.date_range("2024-03-09", "2024-03-12", freq="h")]
    assert zoned(spark, "America/New_York", hours)["inferred_freq"] == "h"


@pytest.mark.parametrize(
    "text", ["2024-01-01T00:06:00Z", "2024-01-01T00:06:00+02:00", "January 5, 2024", "01-05-2024", "2024-01-01 10:00 PM"]
)
def test_more_date_texts(spark, text):
    got = datetime_profile(spark.createDataFrame([(text,)] * 3, "s string")).collect()
    assert len(got) == 1 and got[0].min_date.startswith(("2024-01", "2023-12"))


def test_sentinel_dates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-03",), ("9999-12-31",)], "s string").selectExpr("date(s) AS d")
    got = datetime_profile(df, ["d"]).collect()[0]
    assert (got.max_date, got.inferred_freq) == ("9999-12-31", None)
