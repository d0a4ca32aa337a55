"""First distinct values in row order against a plain walk over the ordered rows."""

import random

import pytest

from frameglass.operators.first_seen import first_values

TYPES = "k int, i bigint, x double, b boolean, s string, t timestamp, d date, m decimal(20, 2), bin binary"
TEXTS = ["", "it's", "a\\b", None, "y" * 64, "y" * 65, "y" * 65 + "z", "ü", "sha256:", "Z"]


def _table(spark, rows, slow, seed):
    draw = random.Random(seed)
    plain = [(i, draw.randrange(slow), draw.randrange(30)) for i in range(rows)]
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "n int, s string")
    base = spark.createDataFrame(plain, "k int, a int, c int").repartition(4)
    return base.join(texts, base["c"] % len(TEXTS) == texts["n"], "left").selectExpr(
        "k", "CAST(IF(k < 100, 7, a) AS BIGINT) AS i",
        "CASE c WHEN 0 THEN double('NaN') WHEN 1 THEN double('-Infinity') WHEN 2 THEN -0.0D WHEN 3 THEN 0.0D ELSE c / 7.0D END AS x",
        "IF(c > 20, NULL, c > 10) AS b", "s", "timestamp_micros(c * 1000001L) AS t", "date_add(DATE'2020-02-27', c) AS d",
        "CAST(c AS DECIMAL(20, 2)) AS m", "CAST(s AS BINARY) AS bin",
    )


def _walk(df, c, n):
    """Values of the rows in order of k, each once."""
    shown = f"CAST({c} AS STRING)" if c != "x" else "CAST(CASE WHEN NOT isnan(x) THEN x + 0.0D END AS STRING)"
    seen = dict.fromkeys(r.v for r in df.selectExpr("k", f"{shown} AS v").orderBy("k").collect())
    return [None if v and "Infinity" in v else v for v in list(seen)[:n]]


@pytest.mark.parametrize("first_rows", [1, 7, 1000])
def test_all_types_like_a_walk(spark, first_rows):
    df = _table(spark, 300, 4, first_rows).cache()
    cols = df.columns[1:]
    got = {}
    for r in first_values(df, cols, ["k"], first_rows=first_rows).orderBy("rank").collect():
        got.setdefault(r["column"], []).append(r["value"])
    for c in cols:
        assert got[c] == _walk(df, c, 10), c
    df.unpersist()


@pytest.mark.parametrize("first_rows", [1, 2, 3, 5, 50])
def test_ties_give_the_smaller_value_first(spark, first_rows):
    rows = [(i // 4, v) for i, v in enumerate(["d", "c", "b", "a", "h", "g", None, "e"])]
    df = spark.createDataFrame(rows, "k int, s string").repartition(3)
    got = [r.value for r in first_values(df, ["s"], ["k"], first_rows=first_rows).orderBy("rank").collect()]
    assert got == ["a", "b", "c", "d", None, "e", "g", "h"]


def test_empty_tables_odd_names_and_null_keys(spark):
    assert first_values(spark.createDataFrame([], "k int, `a.b` string"), ["a.b"], ["k"]).collect() == []
    df = spark.createDataFrame([(None, "late?"), (2, "x"), (1, "w")], "`k y` int, `a.b` string").withColumnRenamed("k y", "ord")
    got = [r.value for r in first_values(df, ["a.b", "ord"], ["ord"], first_rows=2).where("column = 'a.b'").orderBy("rank").collect()]
    assert got == ["late?", "w", "x"]  # null keys come first
    with pytest.raises(ValueError):
        first_values(df, ["a.b"], [])
    with pytest.raises(ValueError):
        first_values(df, ["none"], ["ord"])


def test_no_value_is_moved_for_long_columns(spark):
    """A column of many values, sorted like the key, takes aggregates only: a row of each task and column moves."""
    df = spark.range(0, 40_000, numPartitions=4).selectExpr("id AS k", "id DIV 2000 AS slow", "id AS fast")
    got = {r["column"]: r["value"] for r in first_values(df, ["slow", "fast"], ["k"]).where("rank = 10").collect()}
    assert got == {"slow": "9", "fast": "9"}
