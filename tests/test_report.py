"""The full report of a small table against pandas, and known normality values."""

import math

import numpy as np
import pandas as pd
import pytest

from frameglass import profile
from frameglass.functions.normality import shapiro_wilk

N = 60


def table():
    rng = np.random.default_rng(7)
    out = pd.DataFrame(
        {
            "key": range(100, 100 + N),
            "day": [str(d.date()) for d in pd.date_range("2024-01-01", periods=N, freq="3D")],
            "city": rng.choice(["north", "south", "east"], N, p=[0.6, 0.3, 0.1]),
            "kind": rng.choice(["a", "b"], N),
            "amount": np.round(rng.lognormal(3, 1, N), 2),
            "level": rng.integers(0, 4, N),
        }
    )
    out.loc[[3, 9, 12, 40, 41], "city"] = None
    return out


@pytest.fixture(scope="module")
def pdf():
    return table()


@pytest.fixture(scope="module")
def ours(spark, pdf):
    rows = [tuple(None if v is None else getattr(v, "item", lambda v=v: v)() for v in row) for row in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "key bigint, day string, city string, kind string, amount double, level bigint")
    return profile(df.repartition(3), "small", order_by=["key"]).to_dict()["eda_report"]


NUMBERS = ["key", "amount", "level"]


def near(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_schema(ours, pdf):
    assert (ours["schema"]["n_rows"], ours["schema"]["n_cols"]) == pdf.shape
    for column in ours["schema"]["columns"]:
        s = pdf[column["name"]]
        assert column["n_nulls"] == s.isna().sum() and column["n_unique"] == s.nunique()
        assert column["first_10_unique_values"] == [None if v is None else v for v in s.unique().tolist()[:10]]
        assert column["dtype"] == str(s.dtype)


def test_missing(ours):
    assert ours["missing_and_duplicates"] == {
        "duplicate_rows": 0, "duplicate_pct": 0.0, "columns": {"city": {"null_count": 5, "null_pct": 8.33}},
    }


def test_numeric(ours, pdf):
    assert list(ours["univariate"]["numeric"]) == NUMBERS
    for name, got in ours["univariate"]["numeric"].items():
        s = pdf[name].astype(float)
        expected = {
            "mean": s.mean(), "median": s.median(), "std": s.std(), "min": s.min(), "max": s.max(),
            "p25": s.quantile(0.25), "p75": s.quantile(0.75), "skewness": s.skew(), "kurtosis": s.kurt(),
            "zeros_pct": round((s == 0).mean() * 100, 2),
        }
        for key, value in expected.items():
            assert near(got[key], value), (name, key)


def test_categorical(ours, pdf):
    assert list(ours["univariate"]["categorical"]) == ["day", "city", "kind"]
    for name, got in ours["univariate"]["categorical"].items():
        counts = pdf[name].value_counts()
        p = counts / counts.sum()
        assert near(got["entropy"], float(-(p * np.log2(p + 1e-9)).sum()))
        assert got["mode"] == pdf[name].mode().iloc[0] and got["cardinality"] == len(counts)
        assert [(t["value"], t["count"]) for t in got["top_values"]] == list(counts.head(5).items())


def test_datetime(ours):
    assert ours["datetime"] == {
        "day": {
            "min_date": "2024-01-01", "max_date": "2024-06-26", "date_range_days": 177, "inferred_freq": "3D",
            "gaps_count": 0, "seasonality_hint": "unknown", "timezone": "naive",
        }
    }


def test_correlations(ours, pdf):
    got = ours["correlations"]
    for pair, value in got["pearson"].items():
        a, b = pair.split("__")
        assert value == round(pdf[a].corr(pdf[b]), 4)
    # Sixty days are above the cap of categories.
    assert list(got["cramers_v"]) == ["city__kind"]
    cells = pd.crosstab(pdf["city"], pdf["kind"]).to_numpy().astype(float)
    fit = np.outer(cells.sum(1), cells.sum(0)) / cells.sum()
    v = math.sqrt(((cells - fit) ** 2 / fit).sum() / cells.sum())
    assert got["cramers_v"]["city__kind"] == round(v, 4)
    sizes = [abs(p["value"]) for p in got["top_corr_pairs"]]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) == 4


def test_distributions(ours, pdf):
    for name, got in ours["distributions"].items():
        s = pdf[name].astype(float)
        low, high = s.quantile(0.25), s.quantile(0.75)
        reach = 1.5 * (high - low)
        outside = pdf[(s < low - reach) | (s > high + reach)]
        assert got["outlier_summary"]["count"] == len(outside)
        assert [k[0] for k in got["outlier_summary"]["preview_keys"]] == outside["key"].tolist()[:10]
        assert [b["count"] for b in got["histogram_bins"]] == np.histogram(s, 10)[0].tolist()


def test_quality(ours):
    score = ours["data_quality_score"]
    outliers = sum(d["outlier_summary"]["count"] for d in ours["distributions"].values())
    assert score["completeness"] == round(1 - 5 / (N * 6), 4) and score["uniqueness"] == score["timeliness"] == 1.0
    assert score["consistency"] == round(1 - outliers / N / 3, 4)
    assert near(score["overall_score"], round(0.35 * score["completeness"] + 0.25 + 0.25 * score["consistency"] + 0.15, 4))
    assert score["flags"] == ["high null in 'city' (8.33%)"]


def test_known_normality_values():
    # P of an even run of 50 numbers, and of five repeated levels.
    even = np.arange(1001, 1051, dtype=float)
    levels = np.repeat([0.0, 0.05, 0.1, 0.15, 0.2], [16, 10, 11, 6, 7])
    assert round(shapiro_wilk(even)[1], 5) == 0.05809
    assert round(shapiro_wilk(levels)[1], 5) == 4e-05


def test_options_reach_the_sections(spark):
    df = spark.range(400).selectExpr("id AS k", "randn(1) AS x", "string(id % 60) AS many", "string(id % 3) AS few", "string(id % 4) AS other")
    p = profile(df, "t", order_by=["k"], test_rows=50, max_categories=60, approximate_unique=True)
    assert {r.tested for r in p["normality"].collect()} == {50}
    assert p["cramers_v"].count() == 3
    assert profile(df, "t")["cramers_v"].count() == 1


def test_normality_reads_the_rows_once(spark, monkeypatch):
    """Sizes come from counted values, and the rows of the normality test are drawn by one scan."""
    from frameglass.operators import distribution

    columns = ["id", "x", "y", "none", "far"]
    rows = [(i, (i * 37 % 101) / 7, None if i % 3 else float(i % 13), None, (float("inf"), float("nan"), -0.0, 0.0)[i % 300] if i < 4 else float(-i)) for i in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'id' else 'double'}" for c in columns)).repartition(3)
    shown = lambda table: sorted(map(tuple, table.collect()))
    expected = shown(distribution.normality(df, key=["id"], test_rows=50))
    draws, drawn = [], distribution._drawn
    monkeypatch.setattr(distribution, "_drawn", lambda *args: draws.append(1) or drawn(*args))
    found = profile(df, "t", order_by=["id"], test_rows=50)
    assert shown(found["normality"]) == expected
    assert [r[:3] for r in expected] == [("far", 298, 50), ("id", 300, 50), ("x", 300, 50), ("y", 100, 50)]
    assert len(draws) == 1
