"""Column operations and chains against pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameglass import Chain
from frameglass.operators.prep import (
    CustomTransform,
    DropNullRows,
    EncodeLabel,
    EncodeOneHot,
    EncodeOrdinal,
    ImputeConstant,
    ImputeMean,
    ImputeMedian,
    ImputeMode,
    OutlierIQR,
    OutlierZScore,
    PandasTransform,
    PercentileClip,
    ScaleMinMax,
    ScaleRobust,
    ScaleStandard,
    SqlTransform,
)
from frameglass.operators.prep.categories import Categories, ranked_values
from frameglass.streaming import score_available, transform_stream

NAN = float("nan")
ROWS = [(i, None if i % 4 == 0 else i % 7, NAN if i % 5 == 0 else i * 1.5, 9.0 if i % 3 else None, "abc"[i % 3] if i % 6 else None) for i in range(40)]
SCHEMA = "k int, i int, x double, flat double, s string"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([*ROWS, (40, 6, 900.0, 9.0, "z")], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def pdf():
    out = pd.DataFrame([*ROWS, (40, 6, 900.0, 9.0, "z")], columns=["k", "i", "x", "flat", "s"])
    return out.astype({"i": float, "x": float, "flat": float})


def column(result, name):
    return [r[name] for r in result.orderBy("k").select("k", name).collect()]


def assert_like(result, name, expected):
    got = column(result, name)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        missing = b is None or (isinstance(b, float) and math.isnan(b))
        assert (a is None) if missing else (a == b if isinstance(b, str) else math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


NUMS = ["i", "x", "flat"]


@pytest.mark.parametrize("step, value", [(ImputeMean, lambda s: s.mean()), (ImputeMedian, lambda s: s.median()), (ImputeMode, lambda s: s.mode().iloc[0])])
def test_impute_numbers(df, pdf, step, value):
    out = step(NUMS).fit_transform(df)
    for c in NUMS:
        assert_like(out, c, pdf[c].fillna(value(pdf[c])).tolist())
    assert out.columns == df.columns


def test_impute_mode_texts_and_empty(spark, df, pdf):
    assert_like(ImputeMode(["s"]).fit_transform(df), "s", pdf["s"].fillna(pdf["s"].mode().iloc[0]).tolist())
    empty = spark.createDataFrame([(1, None)], "k int, s string")
    assert column(ImputeMode(["s"]).fit_transform(empty), "s") == [None]


def test_impute_constant(df, pdf):
    out = ImputeConstant({"i": 0.5, "s": "none"}, ["i", "x", "s"]).fit_transform(df)
    assert_like(out, "i", pdf["i"].fillna(0.5).tolist())
    assert_like(out, "s", pdf["s"].fillna("none").tolist())
    assert dict(ImputeConstant(0, ["i"]).fit_transform(df).dtypes)["i"] == "int"
    with pytest.raises(TypeError):
        ImputeConstant("none", ["x"]).fit_transform(df)


def test_drop_null_rows_reads_nan(df, pdf):
    assert DropNullRows(["x", "s"]).fit_transform(df).count() == len(pdf.dropna(subset=["x", "s"]))


def test_outliers(df, pdf):
    x = pdf["x"]
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert_like(OutlierIQR("clip", ["x"]).fit_transform(df), "x", x.clip(lo, hi).tolist())
    assert OutlierIQR("drop", ["x"]).fit_transform(df).count() == (~((x < lo) | (x > hi))).sum()
    m, s = x.mean(), x.std()
    assert_like(OutlierZScore(2, "clip", ["x"]).fit_transform(df), "x", x.clip(m - 2 * s, m + 2 * s).tolist())
    kept = ~(((x - m) / s).abs() > 2)
    assert OutlierZScore(2, "drop", ["x", "flat"]).fit_transform(df).count() == kept.sum()
    assert_like(PercentileClip(0.1, 0.9, ["x"]).fit_transform(df), "x", x.clip(x.quantile(0.1), x.quantile(0.9)).tolist())
    with pytest.raises(ValueError):
        PercentileClip(0.9, 0.1)
    with pytest.raises(ValueError):
        OutlierIQR("keep")


def test_scaling(df, pdf):
    x = pdf["x"]
    out = ScaleMinMax((-1, 3), ["x", "flat"]).fit_transform(df)
    assert_like(out, "x", ((x - x.min()) / (x.max() - x.min()) * 4 - 1).tolist())
    assert column(out, "flat") == [-1.0] * len(pdf)
    out = ScaleStandard(["x", "flat"]).fit_transform(df)
    assert_like(out, "x", ((x - x.mean()) / x.std()).tolist())
    assert column(out, "flat") == [0.0] * len(pdf)
    out = ScaleRobust(["x", "flat"]).fit_transform(df)
    assert_like(out, "x", ((x - x.median()) / (x.quantile(0.75) - x.quantile(0.25))).tolist())


def test_statistics_of_one_row_and_none(spark):
    one = spark.createDataFrame([(1, 5.0, None)], "k int, x double, y double")
    assert column(ScaleStandard(["x"]).fit_transform(one), "x") == [None]  # the deviation of one value is unknown
    assert column(OutlierZScore(cols=["x"]).fit_transform(one), "x") == [5.0]
    for step in (ImputeMean, ImputeMedian, OutlierIQR, ScaleMinMax, ScaleRobust):
        assert column(step(cols=["y"]).fit_transform(one), "y") == [None]


def test_onehot(spark, df, pdf):
    step = EncodeOneHot(["s"]).fit(df)
    out = step.transform(df)
    assert out.columns == ["k", "i", "x", "flat", "s_a", "s_b", "s_c", "s_z"]
    for v in "abcz":
        assert column(out, f"s_{v}") == (pdf["s"] == v).astype(int).tolist()
    new = spark.createDataFrame([(1, "never"), (2, None), (3, "b")], "k int, s string")
    assert column(step.transform(new), "s_b") == [0, 0, 1] and column(step.transform(new), "s_a") == [0, 0, 0]


def test_onehot_awkward_names(spark):
    odd = spark.createDataFrame([(1, "x y"), (2, "p.q")], "k int, `a.b` string")
    out = EncodeOneHot(["a.b"]).fit_transform(odd)
    assert out.columns == ["k", "a.b_p.q", "a.b_x y"]
    assert [tuple(r) for r in out.orderBy("k").collect()] == [(1, 0, 1), (2, 1, 0)]


def test_ordinal_and_label(spark, df):
    out = EncodeOrdinal({"s": ["c", "a"]}, ["s"]).fit_transform(df)
    code = {"c": 0, "a": 1}
    assert column(out, "s") == [code.get(v) for v in column(df, "s")]
    step = EncodeLabel(["s"]).fit(df)
    assert column(step.transform(df), "s") == [None if v is None else "abcz".index(v) for v in column(df, "s")]
    assert column(step.transform(spark.createDataFrame([(1, "new")], "k int, s string")), "s") == [None]


def test_large_label_ranking(spark):
    df = spark.range(6000).selectExpr("id AS k", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('v', id % 2500) END AS s")
    known = sorted({r["s"] for r in df.collect()})
    ranked = {r["value"]: r["code"] for r in ranked_values(df, "s", run_rows=200).collect()}
    assert ranked == {v: i for i, v in enumerate(known)}
    step = EncodeLabel(["s"]).fit(df)
    assert step.params["s"]["categories"].table is not None
    out = step.transform(df)
    assert column(out, "s") == [known.index(v) for v in column(df, "s")]
    with pytest.raises(ValueError, match="more than 100"):
        EncodeOneHot(["s"], max_categories=100).fit(df)
    wide = EncodeOneHot(["s"]).fit(df)
    assert wide.params["s"]["categories"] == known and len(known) > 999


def test_sparse_onehot(spark, df, tmp_path):
    step = EncodeOneHot(["s"], form="sparse").fit(df)
    out = step.transform(df)
    assert out.columns == ["k", "i", "x", "flat", "s_onehot"]
    expected = [(4, [], []) if v is None else (4, ["abcz".index(v)], [1]) for v in column(df, "s")]
    assert [tuple(v) for v in column(out, "s_onehot")] == expected
    new = spark.createDataFrame([(1, "never"), (2, None), (3, "b")], "k int, s string")
    assert [tuple(v) for v in column(step.transform(new), "s_onehot")] == [(4, [], []), (4, [], []), (4, [1], [1])]
    with pytest.raises(ValueError, match="neither"):
        EncodeOneHot(["s"], form="dense")


def test_many_categories_stay_on_spark(spark, tmp_path, monkeypatch):
    wide = spark.range(200_000).selectExpr("id AS k", "concat('v', lpad(id % 100000, 6, '0')) AS s")
    with pytest.raises(ValueError, match="100000 categories, more than 10000"):
        EncodeOneHot(["s"]).fit(wide)
    monkeypatch.setattr(Categories, "listed", None)
    chain = Chain([EncodeOneHot(["s"], form="sparse")]).fit(wide)
    known = chain.steps[0].params["s"]["categories"]
    assert known.values is None and (known.rows, known.bytes) == (100_000, 700_000)
    chain.save(spark, str(tmp_path / "chain"))
    for fitted in (chain, Chain.load(spark, str(tmp_path / "chain"))):
        odd = fitted.transform(wide).where("s_onehot.size <> 100000 OR s_onehot.indices <> array(k % 100000) OR s_onehot.values <> array(1)")
        assert odd.count() == 0


def test_contract(df):
    with pytest.raises(ValueError, match="no such columns"):
        ImputeMean(["nope"]).fit(df)
    with pytest.raises(TypeError, match="numbers"):
        ImputeMean().fit(df)  # no columns given means all, and one of them is a text
    with pytest.raises(TypeError, match="categories"):
        EncodeLabel(["x"]).fit(df)
    with pytest.raises(RuntimeError, match="before transform"):
        ScaleStandard(["x"]).transform(df)
    with pytest.raises(ValueError, match="empty"):
        Chain.from_steps([])
    with pytest.raises(ValueError, match="unknown operation"):
        Chain.from_steps([{"operation": "missing", "strategy": {"type": "guess"}}])


def test_custom(df):
    out = CustomTransform(lambda d: d.withColumn("twice", F.col("x") * 2)).fit_transform(df)
    assert out.columns[-1] == "twice"
    with pytest.raises(TypeError, match="must return a DataFrame"):
        CustomTransform(lambda d: 5).fit_transform(df)

    def broken(d):
        return d.nothing_here()

    with pytest.raises(RuntimeError, match="nothing_here"):
        CustomTransform(broken).fit_transform(df)
    assert SqlTransform(["k", "k + 1 AS next"]).fit_transform(df).columns == ["k", "next"]
    with pytest.raises(ValueError):
        SqlTransform([" "])
    add = lambda batch: batch.assign(y=batch["k"] + 1)[["k", "y"]]
    assert column(PandasTransform(add, "k int, y int").fit_transform(df), "y") == list(range(1, 42))


STEPS = [
    {"operation": "missing", "strategy": {"type": "mode"}, "cols": ["s"]},
    {"operation": "missing", "strategy": {"type": "median"}, "cols": ["x"]},
    {"operation": "outlier", "strategy": {"type": "iqr", "action": "drop"}, "cols": ["x"]},
    {"operation": "scaling", "strategy": {"type": "minmax", "feature_range": [0, 2]}, "cols": ["x"]},
    {"operation": "encoding", "strategy": {"type": "onehot"}, "cols": ["s"]},
    {"operation": "custom", "strategy": {"type": "sql", "exprs": ["*", "x * 10 AS x10"]}},
]


def by_key(result):
    return sorted(map(tuple, result.collect()))


def test_fitting_order_matters(df, pdf):
    stepwise = Chain.from_steps(STEPS).fit_transform(df)
    at_once = Chain.from_steps(STEPS).fit(df).transform(df)
    filled = pdf["x"].fillna(pdf["x"].median())
    q1, q3 = filled.quantile(0.25), filled.quantile(0.75)
    kept = filled[~((filled < q1 - 1.5 * (q3 - q1)) | (filled > q3 + 1.5 * (q3 - q1)))]
    assert_like(stepwise, "x", ((kept - kept.min()) / (kept.max() - kept.min()) * 2).tolist())
    raw = pdf["x"]
    q1, q3 = raw.quantile(0.25), raw.quantile(0.75)
    kept = filled[~((filled < q1 - 1.5 * (q3 - q1)) | (filled > q3 + 1.5 * (q3 - q1)))]
    assert_like(at_once, "x", ((kept - raw.min()) / (raw.max() - raw.min()) * 2).tolist())


def test_save_and_load(spark, df, tmp_path):
    chain = Chain.from_steps(STEPS)
    expected = by_key(chain.fit(df).transform(df))
    chain.save(spark, str(tmp_path / "chain"))
    assert by_key(Chain.load(spark, str(tmp_path / "chain")).transform(df)) == expected
    with pytest.raises(ValueError, match="cannot be saved"):
        Chain([CustomTransform(lambda d: d)]).fit(df).save(spark, str(tmp_path / "other"))


def test_save_large_codes_and_dates(spark, tmp_path):
    rows = [(i, f"c{i}", None if i % 2 else pd.Timestamp(2024, 1, 1 + i % 3).to_pydatetime()) for i in range(1500)]
    df = spark.createDataFrame(rows, "k int, s string, t timestamp_ntz")
    chain = Chain([ImputeMode(["t"]), EncodeLabel(["s"])]).fit(df)
    chain.save(spark, str(tmp_path / "chain"))
    assert by_key(Chain.load(spark, str(tmp_path / "chain")).transform(df)) == by_key(chain.transform(df))


def test_stream_equals_batch(spark, df, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(source)
    chain = Chain.from_steps(STEPS).fit(df)
    check = str(tmp_path / "progress")
    out = score_available(spark, chain, source, df.schema, target, checkpoint=check)
    assert by_key(out) == by_key(chain.transform(df))
    # A second run sees no new file; a new file is added once.
    assert score_available(spark, chain, source, df.schema, target, checkpoint=check).count() == out.count()
    before = out.count()
    df.limit(2).coalesce(1).write.mode("append").parquet(source)
    assert score_available(spark, chain, source, df.schema, target, checkpoint=check).count() > before
    with pytest.raises(ValueError, match="streaming"):
        transform_stream(chain, df)


def test_categories_hold_one_form(spark, df):
    assert Categories(values=["a"]).code_table(df).collect()[0]["code"] == 0
