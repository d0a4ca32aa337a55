"""Profile operators against pandas and on edge frames."""

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from frameglass import profile
from frameglass.functions.normality import shapiro_wilk
from frameglass.operators.association import cramers_v_pairs, pearson_pairs, top_pairs
from frameglass.operators.categorical import categorical_profile, top_values
from frameglass.operators.distribution import bin_edges, histogram, normality
from frameglass.operators.duplicates import duplicate_rows
from frameglass.operators.numeric import fit_fences, numeric_profile
from frameglass.operators.quantiles import exact_quantiles
from frameglass.operators.sampling import row_sample
from frameglass.operators.schema import column_types, null_counts, table_shape
from frameglass.operators.first_seen import first_values
from frameglass.operators.value_counts import n_unique

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
NAN, INF = float("nan"), float("inf")
numbers = st.lists(st.one_of(st.none(), st.sampled_from([0.0, 1.0, -2.5, INF, NAN]), st.integers(-50, 50).map(float)), min_size=1, max_size=30)


def frame(spark, values, name="x", kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def same(a, b):
    if b is None or (isinstance(b, float) and math.isnan(b)):
        return a is None
    return a is not None and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7)


@FEW
@given(numbers)
def test_numeric_profile_like_pandas(spark, values):
    got = numeric_profile(frame(spark, values)).first()
    s = pd.Series(values, dtype=float).replace([INF, -INF], np.nan).dropna()
    expected = {
        "mean": s.mean(), "median": s.median(), "std": s.std(), "min": s.min(), "max": s.max(),
        "p25": s.quantile(0.25), "p75": s.quantile(0.75), "skewness": s.skew(), "kurtosis": s.kurt(),
    }
    for name, value in expected.items():
        assert same(got[name], value), (name, got[name], value)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    outside = ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum()
    assert got["outlier_count"] == outside


@pytest.mark.parametrize("values", [[], [None, None], [3.0], [5.0] * 4, [1.0, 2.0], [1.0, 2.0, 4.0]])
def test_numeric_edges(spark, values):
    got = numeric_profile(frame(spark, values)).first()
    s = pd.Series(values, dtype=float).dropna()
    for name, value in {"mean": s.mean(), "std": s.std(), "skewness": s.skew(), "kurtosis": s.kurt()}.items():
        assert same(got[name], value), (name, got[name], value)


@pytest.mark.parametrize("seed", range(3))
def test_bracketed_quantiles_are_exact(spark, seed):
    rng = np.random.default_rng(seed)
    hot = np.where(rng.random(5000) < 0.4, 7.0, np.round(rng.normal(7, 3, 5000), 2))
    data = pd.DataFrame({"hot": hot, "heavy": rng.pareto(0.4, 5000), "flat": 1.0, "few": rng.integers(0, 3, 5000).astype(float)})
    data.loc[::17, "heavy"] = np.nan
    ps = [0.0, 0.05, 0.25, 0.4, 0.5, 0.7001, 0.75, 0.95, 1.0]
    df = spark.createDataFrame(data).repartition(7)
    got = exact_quantiles(df, {c: ps for c in data}, inside_rows=3)
    for c in data:
        for p in ps:
            assert same(got[c][p], data[c].quantile(p)), (c, p)


def test_bracketed_quantiles_without_values(spark):
    got = exact_quantiles(frame(spark, [None, NAN]), {"x": [0.5]})
    assert got == {"x": {0.5: None}}


def test_nulls_nan_and_shape(spark):
    df = frame(spark, [1.0, NAN, None, INF])
    assert table_shape(df).first()["n_rows"] == 4
    assert null_counts(df).first()["null_count"] == 2
    assert null_counts(frame(spark, [1.0])).count() == 0
    assert n_unique(profile_view(df), ["x"]).first()["n_unique"] == 2


def profile_view(df):
    from frameglass.functions.kinds import normalise

    return normalise(df)


def test_types(spark):
    df = spark.createDataFrame([(1, None, True, [1], datetime(2024, 1, 1))], "i int, s string, b boolean, a array<int>, t timestamp_ntz")
    got = {r["column"]: r["inferred_type"] for r in column_types(df).collect()}
    assert got == {"i": "integer", "s": "empty", "b": "boolean", "a": "string", "t": "datetime64"}


def test_duplicates(spark):
    rows = [(1, "a", NAN), (1, "a", None), (None, "b", 0.0), (None, "b", -0.0), (2, None, 1.0), (2, None, 2.0)]
    df = spark.createDataFrame(rows, "i int, s string, x double")
    assert duplicate_rows(df).first()["duplicate_rows"] == 2
    # The hash passes over nulls, so the same values in other columns must stay apart.
    shifted = spark.createDataFrame([("v", None), (None, "v")], "a string, b string")
    assert duplicate_rows(shifted).first()["duplicate_rows"] == 0
    assert tuple(duplicate_rows(shifted.limit(0)).first()) == (0, 0.0)


def test_categorical_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", "b", "a", "c", None])], "i int, s string")
    assert categorical_profile(df).first()["mode"] == "a"
    by_value = [r["value"] for r in top_values(df, ["s"]).orderBy("rank").collect()]
    by_place = [r["value"] for r in top_values(df, ["s"], order_by=["i"]).orderBy("rank").collect()]
    assert by_value == ["a", "b", "c"] and by_place == ["b", "a", "c"]


def test_constant_entropy_keeps_the_shift(spark):
    got = categorical_profile(frame(spark, ["k"] * 3, "s", "string")).first()
    assert math.isclose(got["entropy"], -math.log2(1 + 1e-9), rel_tol=1e-6)


def test_first_values_in_row_order(spark):
    # The first 200 rows show one value of `late` only, so it has to be looked for beyond them.
    rows = [(i, "x" if i < 250 else f"v{i % 20}", None if i % 2 else i / 2, "same") for i in range(600)]
    df = spark.createDataFrame(rows, "i int, late string, n double, one string").repartition(5)
    got = {}
    for r in first_values(df, ["late", "n", "one"], ["i"]).orderBy("rank").collect():
        got.setdefault(r["column"], []).append(r["value"])
    assert got["late"] == ["x", *[f"v{i % 20}" for i in range(250, 259)]]
    assert got["n"] == ["0.0", None, *[str(float(k)) for k in range(1, 9)]]
    assert got["one"] == ["same"]


def test_pearson_like_numpy(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame(rng.normal(size=(200, 3)), columns=list("abc"))
    data["b"] += data["a"]
    data.loc[::5, "a"] = np.nan
    data["flat"] = 2.0
    data["wild"] = np.where(data.index == 3, INF, data["c"])
    got = {(r["col_a"], r["col_b"]): r["value"] for r in pearson_pairs(spark.createDataFrame(data)).collect()}
    filled = data.fillna(data.mean())
    for (a, b), value in got.items():
        if "flat" in (a, b) or "wild" in (a, b):
            assert value == 0.0
        else:
            assert same(value, float(np.corrcoef(filled[a], filled[b])[0, 1]))


def test_cramers_cap_and_nulls(spark):
    rows = [(f"v{i % 51}", f"k{i % 50}", None if i % 50 == 0 else f"k{i % 50}", "one") for i in range(2550)]
    df = spark.createDataFrame(rows, "over string, at string, near string, flat string")
    got = {(r["col_a"], r["col_b"]): r["value"] for r in cramers_v_pairs(df).collect()}
    assert set(got) == {("at", "near"), ("at", "flat"), ("near", "flat")}
    assert same(got["at", "near"], 1.0) and got["at", "flat"] == 0.0


def test_top_pairs_order(spark):
    schema = "col_a string, col_b string, value double, pos int"
    pearson = spark.createDataFrame([("a", "b", -0.5, 0), ("a", "c", 0.1, 1)], schema)
    cramers = spark.createDataFrame([("s", "t", 0.5, 0), ("s", "u", 0.9, 1)], schema)
    assert [r["col_b"] for r in top_pairs(pearson, cramers, 3).collect()] == ["u", "b", "t"]


@FEW
@given(st.lists(st.integers(-30, 30).map(lambda v: v / 7), min_size=1, max_size=60))
def test_histogram_like_numpy(spark, values):
    got = histogram(frame(spark, values)).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=10)
    assert sum(r["cnt"] for r in got) == len(values)
    assert np.allclose([r["lo"] for r in got], edges[:-1]) and got[-1]["hi"] == edges[-1]
    # An edge that two formulas round differently may move a value that lies on it.
    assert np.abs(np.cumsum([r["cnt"] for r in got]) - np.cumsum(counts)).max() <= max(values.count(v) for v in values)


def test_histogram_of_constant(spark):
    got = histogram(frame(spark, [2.0, 2.0, NAN])).orderBy("bin").collect()
    assert [r["cnt"] for r in got] == [0] * 5 + [2] + [0] * 4
    assert bin_edges(2.0, 2.0)[0] == 1.5 and bin_edges(2.0, 2.0)[-1] == 2.5


def test_shapiro_small_samples():
    assert shapiro_wilk(np.array([1.0, 2.0])) == (None, None)
    assert shapiro_wilk(np.array([4.0] * 9)) == (1.0, 1.0)
    w, p = shapiro_wilk(np.array([1.0, 2.0, 3.0]))
    assert same(w, 1.0) and same(p, 1.0)
    # A worked example of 11 weights from the paper that introduced the test.
    w, p = shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert math.isclose(w, 0.79, abs_tol=0.005) and 0.005 < p < 0.01


def test_normality_sample_is_bounded_and_repeatable(spark):
    df = spark.range(40_000).selectExpr("id", "id % 1000 / 10 AS x", "CAST(NULL AS DOUBLE) AS none")
    first = normality(df, ["x", "none"], key=["id"]).collect()
    assert first == normality(df.repartition(5), ["x", "none"], key=["id"]).collect()
    assert len(first) == 1 and first[0]["tested"] == 5000 and first[0]["n"] == 40_000


def test_row_sample(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    got = [r["k"] for r in row_sample(df, ["k"], 700).collect()]
    assert len(got) == len(set(got)) == 700
    assert sorted(got) == sorted(r["k"] for r in row_sample(df.repartition(9), ["k"], 700).collect())
    assert row_sample(df, ["k"], 6000).count() == 5000


def test_fences_skip_empty_columns(spark):
    assert fit_fences(frame(spark, [None, NAN, INF]), ["x"]) == {"x": None}


@pytest.mark.parametrize(
    "rows, schema",
    [
        ([], "i int, s string, x double"),
        ([(1, "a", 2.0)], "i int, s string, x double"),
        ([(None, None, None)] * 3, "i int, s string, x double"),
        ([("a", "b")] * 3, "s string, t string"),
        ([(1, 2.0)] * 3, "`a.b` int, `c d` double"),
    ],
)
def test_report_on_edge_frames(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    report = profile(df, "edge", order_by=df.columns[:1]).to_dict()["eda_report"]
    assert report["schema"]["n_rows"] == len(rows)
    score = report["data_quality_score"]
    assert 0.0 <= score["overall_score"] <= 1.0


def test_normality_with_a_key_that_repeats(spark):
    df = spark.range(0, 200_000, 1, 6).selectExpr("id % 7 AS k", "randn(3) AS x")
    row = normality(df, ["x"], key=["k"]).collect()[0]
    assert (row.n, row.tested, row.is_normal) == (200_000, 5_000, True)
    named = normality(df.withColumnRenamed("x", "draw"), ["draw"], key=["k"]).collect()[0]
    assert named.tested == 5_000 and named.is_normal
    few = normality(spark.range(0, 50_000, 1, 6).selectExpr("1 AS k", "id % 3 AS x"), ["x"], key=["k"]).collect()[0]
    assert few.tested == 5_000 and not few.is_normal
    unique = spark.range(0, 30_000, 1, 6).selectExpr("id AS k", "id * id AS x")
    again = unique.repartition(3)
    assert normality(unique, ["x"], key=["k"]).collect() == normality(again, ["x"], key=["k"]).collect()


def test_n_unique_of_decimals_and_binary(spark):
    df = spark.sql(
        "SELECT CAST(d AS DECIMAL(38, 1)) AS d, CAST(d AS DECIMAL(22, 1)) AS e, unhex(b) AS b, map(b, 1) AS m "
        "FROM VALUES ('12345678901234567890.1', '00'), ('12345678901234567890.2', '01'), ('12345678901234567890.2', '00') AS t(d, b)"
    )
    got = {r["column"]: r.n_unique for r in n_unique(df, ["d", "e", "b", "m"]).collect()}
    assert got == {"d": 2, "e": 2, "b": 2, "m": None}


def test_first_values_behind_many_nans(spark):
    df = spark.createDataFrame([(i, float("nan") if i < 198 else float(i)) for i in range(218)], "k int, x double")
    got = [r.value for r in first_values(df, ["x"], ["k"]).orderBy("rank").collect()]
    assert got == [None, *(f"{i}.0" for i in range(198, 207))]


def test_duplicates_move_digests_only(spark):
    df = spark.range(1_000).selectExpr("id % 10 AS a", "CASE WHEN id % 2 = 0 THEN 'x' END AS b", "id % 2 = 1 AS c", "CAST(NULL AS STRING) AS d")
    assert tuple(duplicate_rows(df).collect()[0])[0] == 990
    swapped = spark.createDataFrame([("v", None), (None, "v")], "a string, b string")
    assert duplicate_rows(swapped).collect()[0].duplicate_rows == 0
    plan = duplicate_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_wide_tables_take_one_scan(spark, tmp_path):
    wide = spark.range(500).selectExpr(*[f"CASE WHEN id % {7 + i} > 0 THEN double(hash(id, {i}) % 100) END AS n{i}" for i in range(120)],
                                       *[f"string(hash(id, {i}) % 4) AS s{i}" for i in range(30)])
    wide.write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    numbers, texts = [f"n{i}" for i in range(120)], [f"s{i}" for i in range(30)]
    pearson, cramers = pearson_pairs(df, numbers), cramers_v_pairs(df, texts)
    for pairs in (pearson, cramers):
        assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2
    assert "Generate" not in plan_of(cramers)
    pdf = df.toPandas()
    filled = pdf[numbers].fillna(pdf[numbers].mean())
    expected = filled.corr()
    got = {(r.col_a, r.col_b): r.value for r in pearson.collect()}
    assert len(got) == 120 * 119 // 2
    assert all(math.isclose(v, expected.loc[a, b], abs_tol=1e-9) for (a, b), v in got.items())
    assert cramers.count() == 30 * 29 // 2
