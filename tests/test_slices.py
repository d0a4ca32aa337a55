"""Profiles per slice against pandas, on groups that are hot, tiny, null or without usable values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameglass.functions.normality import shapiro_wilk
from frameglass.operators import slices


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    rows = [("hot", i % 2, float(x), int(x) % 50, "abc"[i % 3]) for i, x in enumerate(rng.normal(0, 100, 900))]
    rows += [(None, 1, float(x), int(x), None) for x in rng.exponential(5, 40)]
    rows += [("tiny", 0, 1.5, 2, "z"), ("none", 0, None, None, None), ("odd", 1, math.nan, 4, "q"), ("odd", 1, math.inf, 4, "q"), ("odd", 1, 2.0, None, "r")]
    rows += [("flat", 1, 7.0, 7, "same")] * 12
    return pd.DataFrame(rows, columns=["g", "h.x", "a.b", "whole", "text"]).astype({"whole": "object"}).assign(key=range(len(rows)))


@pytest.fixture(scope="module")
def df(spark, frame):
    schema = "g string, `h.x` int, `a.b` double, whole int, text string, key long"
    rows = [tuple(None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v) and i != 2) else v for i, v in enumerate(r)) for r in frame.itertuples(index=False)]
    return spark.createDataFrame([(a, int(b), c, None if d is None else int(d), e, int(k)) for a, b, c, d, e, k in rows], schema).repartition(5)


def groups(frame, by, col):
    x = pd.to_numeric(frame[col], errors="coerce").replace([np.inf, -np.inf], np.nan)
    for keys, part in frame.assign(x=x).groupby(by, dropna=False):
        yield tuple(None if isinstance(k, float) and math.isnan(k) else k for k in keys), part["x"].dropna()


@pytest.mark.parametrize("by", [["g"], ["g", "h.x"]])
def test_numeric_and_outliers(df, frame, by):
    cols = ["a.b", "whole"]
    got = {(*[r[c] for c in by], r["column"]): r for r in slices.slice_numeric(df, by, cols).collect()}
    fences = {(*[r[c] for c in by], r["column"]): r for r in slices.slice_outliers(df, by, cols).collect()}
    seen = 0
    for col in cols:
        for keys, x in groups(frame, by, col):
            r = got[(*keys, col)]
            seen += 1
            assert r["n"] == len(x)
            if not len(x):
                assert r["median"] is None and r["mean"] is None and r["outlier_count"] == 0 and (*keys, col) not in fences
                continue
            q1, q2, q3 = x.quantile([0.25, 0.5, 0.75])
            lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            assert np.allclose([r["mean"], r["p25"], r["median"], r["p75"], r["min"], r["max"]], [x.mean(), q1, q2, q3, x.min(), x.max()])
            assert r["outlier_count"] == ((x < lo) | (x > hi)).sum() == fences[(*keys, col)]["outlier_count"]
            assert np.allclose([fences[(*keys, col)]["lower_fence"], fences[(*keys, col)]["upper_fence"]], [lo, hi])
            if len(x) > 3:
                assert np.allclose([r["std"], r["skewness"], r["kurtosis"]], [x.std(), x.skew(), x.kurt()], atol=1e-9)
    assert seen == len(got)


def test_missing_and_categorical(df, frame):
    got = {(r["g"], r["column"]): (r["n_rows"], r["null_count"]) for r in slices.slice_missing(df, ["g"]).collect()}
    assert got[None, "text"] == (40, 40) and got["none", "a.b"] == (1, 1) and got["odd", "a.b"] == (3, 1) and ("hot", "text") not in got
    kinds = {r["g"]: r for r in slices.slice_categorical(df, ["g"], ["text"]).collect()}
    assert set(kinds) == {"hot", "tiny", "odd", "flat"}
    assert (kinds["hot"]["mode"], kinds["hot"]["cardinality"], kinds["hot"]["n"]) == ("a", 3, 900)
    assert (kinds["odd"]["mode"], kinds["odd"]["cardinality"]) == ("q", 2)
    assert abs(kinds["hot"]["entropy"] - math.log2(3)) < 1e-6


def test_normality_draws_the_same_rows_whatever_the_layout(df, frame):
    one = {r["g"]: r for r in slices.slice_normality(df, ["g"], ["key"], ["a.b"], test_rows=100).collect()}
    two = {r["g"]: r for r in slices.slice_normality(df.coalesce(1), ["g"], ["key"], ["a.b"], test_rows=100).collect()}
    assert one == two and one["hot"]["tested"] == 100 and one[None]["tested"] == 40 and "none" not in one
    assert one["tiny"]["w"] is None and one["flat"]["w"] == 1.0
    x = next(x for keys, x in groups(frame, ["g"], "a.b") if keys == (None,))
    assert np.allclose([one[None]["w"], one[None]["p_value"]], shapiro_wilk(x.to_numpy()))
    # A key that names no row still gives one sample for all layouts.
    some = [slices.smallest_draws(d, ["h.x"], ["a.b"], ["g"], 50).groupBy("column").agg(F.sum("x").alias("s")).first().s for d in (df, df.coalesce(2))]
    assert math.isclose(*some)


def test_any_quantile_and_many_runs(spark):
    rows = [(i % 3, float(i * 7919 % 1000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, x double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = slices.value_index(df, ["g"], ["x"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.select("run").distinct().count() > 1
    found = slices.order_statistics(index, {"p0": 0, "p10": 0.1, "p99": 0.99, "p100": 1})
    for r in found.collect():
        x = [v for g, v in rows if g == r[slices.SLICE]["g"]]
        assert np.allclose([r["p0"], r["p10"], r["p99"], r["p100"]], np.quantile(x, [0, 0.1, 0.99, 1]))
    with pytest.raises(ValueError):
        slices.order_statistics(index, {"bad": 1.5})


def test_all_sections_and_an_empty_table(df):
    sections = slices.profile_slices(df, ["g"], key=["key"])
    assert list(sections) == ["missing", "numeric", "outliers", "normality", "categorical"]
    empty = slices.profile_slices(df.limit(0), ["g"], key=["key"])
    assert all(s.count() == 0 for s in empty.values())
    with pytest.raises(ValueError):
        slices.profile_slices(df, [])
    with pytest.raises(ValueError):
        slices.profile_slices(df, ["nowhere"])
    with pytest.raises(ValueError):
        slices.profile_slices(df.withColumnRenamed("g", "column"), ["column"])


def test_few_cells_are_moved_for_a_sample(spark):
    """The window of a hot slice gets little more than its sample, which is the same as that of a sort of all rows."""
    df = spark.range(0, 60_000, 1, 8).selectExpr("id AS key", "IF(id % 3 = 0, NULL, 'hot') AS g", "CAST(id * 7919 % 10007 AS DOUBLE) AS x", "IF(id < 40, 1.5D, NULL) AS rare")
    drawn = slices.smallest_draws(df, ["g"], ["x", "rare"], ["key"], 2_000)
    got = {(r[slices.SLICE]["g"], r["column"], r["place"]): r["x"] for r in drawn.collect()}
    rows = df.select("g", "x", "rare", slices.sample_key(["key"]).alias("draw")).collect()
    expected = {}
    for g in ("hot", None):
        for c in ("x", "rare"):
            cells = sorted((r["draw"], r[c]) for r in rows if r["g"] == g and r[c] is not None)
            expected |= {(g, c, i): x for i, (_, x) in enumerate(cells[:2_000], 1)}
    assert got == expected
    plan = drawn._jdf.queryExecution().executedPlan()
    moved = [int(line.split(":")[1]) for line in _written_rows(plan)]
    assert moved and max(moved) < 5_000


def _written_rows(plan):
    """Rows that each shuffle of a plan that ran has written."""
    text = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan
    nodes, out = [text], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() in ("ShuffleQueryStage", "TableCacheQueryStage"):
            node = node.plan()
        if node.nodeName() == "Exchange":
            out.append(f"rows:{node.metrics().apply('shuffleRecordsWritten').value()}")
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return out
