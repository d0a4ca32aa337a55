"""The value index against pandas and the bracket search, over many runs and odd values."""

import math

import numpy as np
import pandas as pd
import pytest

from frameglass.operators import value_index
from frameglass.operators.categorical import categorical_profile, top_values
from frameglass.operators.numeric import fit_fences
from frameglass.operators.quantiles import exact_quantiles
from frameglass.operators.value_counts import n_unique
from frameglass.operators.value_index import ValueIndex
from frameglass.plans import report

PS = (0.0, 0.013, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0)


@pytest.fixture(scope="module")
def many_runs(spark):
    """Adaptive execution would join the small runs of a test to one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(5)
    rows = [
        (int(i), float(x), 7 if i % 3 else int(i) - 900, "abcdefg"[min(int(abs(x) / 40), 6)], float(x) if i % 7 else float("nan"), i % 5 == 0)
        for i, x in enumerate(rng.normal(0, 50, 1800))
    ]
    rows += [(1800, math.inf, None, None, None, None), (1801, -math.inf, 8, "z", math.inf, True), (1802, None, 8, None, -math.inf, None)]
    made = spark.createDataFrame(rows, "key int, `a.b` double, hot long, text string, holes double, flag boolean")
    return made.selectExpr(
        "*", "CAST(key / 7 AS DECIMAL(20, 3)) AS money", "CAST(NULL AS DOUBLE) AS empty", "array(key) AS nested", "CAST(key % 50 AS FLOAT) AS single"
    ).repartition(6).cache()


NUMBERS = ["key", "a.b", "hot", "holes", "money", "empty", "single"]


def test_quantiles_like_pandas(many_runs, df):
    index = ValueIndex(df)
    got = index.quantiles({c: PS for c in NUMBERS})
    assert index.counts("integer").select("run").distinct().count() > 2
    for c in NUMBERS:
        x = pd.Series([None if r[0] is None else float(r[0]) for r in df.select(f"`{c}`").collect()], dtype=float)
        x = x.replace([np.inf, -np.inf], np.nan).dropna()
        for p in PS:
            assert got[c][p] is None if x.empty else math.isclose(got[c][p], x.quantile(p), rel_tol=1e-12, abs_tol=1e-9), (c, p)


def test_same_as_brackets(many_runs, df):
    cols = ["key", "hot", "money", "single"]
    wanted = {c: PS for c in cols}
    assert ValueIndex(df).quantiles(wanted) == exact_quantiles(df, wanted)
    assert ValueIndex(df).fences(NUMBERS) == fit_fences(df, NUMBERS)


def test_counts_serve_cardinality_and_texts(many_runs, df):
    index = ValueIndex(df, order_by=["key"])
    rows = lambda t: sorted(map(tuple, t.collect()), key=repr)
    assert rows(index.n_unique(df.columns)) == rows(n_unique(df, df.columns))
    assert rows(categorical_profile(df, ["text"], counts=index.counts("string"))) == rows(categorical_profile(df, ["text"]))
    ours = top_values(df, ["text"], order_by=["key"], counts=index.counts("string"))
    assert rows(ours) == rows(top_values(df, ["text"], order_by=["key"]))


def test_empty_table_and_wrong_columns(spark):
    index = ValueIndex(spark.createDataFrame([], "x double, s string"))
    assert index.quantiles({"x": (0.5,)}) == {"x": {0.5: None}} and index.quantiles({}) == {}
    assert {r.column: r.n_unique for r in index.n_unique(["x", "s"]).collect()} == {"x": 0, "s": 0}
    for wanted in ({"s": (0.5,)}, {"none": (0.5,)}, {"x": (1.5,)}):
        with pytest.raises(ValueError):
            index.quantiles(wanted)


def test_only_runs_that_hold_a_rank_are_ranked(many_runs, spark, df):
    """The window over values reads the runs of the wanted ranks, not the column."""
    wide = spark.range(20_000).selectExpr("id AS x").repartition(4)
    index = ValueIndex(wide)
    assert index.quantiles({"x": (0.5,)}) == {"x": {0.5: 9999.5}}
    runs = index.counts("integer").groupBy("run").agg({"value": "min", "*": "count"}).collect()
    assert len(runs) > 2 and max(r["count(1)"] for r in runs) < 12_000


def test_a_profile_counts_each_class_once(spark, df, monkeypatch):
    counted = []
    real = value_index.value_counts

    def counting(frame, cols, *args, **more):
        counted.extend(cols)
        return real(frame, cols, *args, **more)

    monkeypatch.setattr(value_index, "value_counts", counting)
    monkeypatch.setattr(report, "fit_fences", lambda *_: pytest.fail("brackets are not needed"))
    report.profile(df.drop("nested"), order_by=["key"])
    assert sorted(counted) == sorted(c for c in df.columns if c != "nested")
