"""Pair statistics in tiles: the same values whatever a task may hold."""

import numpy as np
import pandas as pd
import pytest

from frameglass.operators import association
from frameglass.operators.association import cramers_v_pairs, pearson_pairs


@pytest.fixture(scope="module")
def wide(spark):
    draw = np.random.default_rng(7)
    frame = pd.DataFrame({f"n.{i}": draw.normal(size=200) + i for i in range(7)})
    frame["n.2"] = frame["n.0"] * 3 - frame["n.1"]
    frame.loc[::9, "n.4"] = np.nan
    frame["n.6"] = 5.0
    for i in range(6):
        frame[f"s.{i}"] = draw.choice(list("abcdefg")[: i + 1], 200)
    frame["s.5"] = frame["s.4"].where(frame.index % 5 > 0, None)
    return frame, spark.createDataFrame(frame).repartition(3)


def values(df):
    return {(r.col_a, r.col_b): (round(r.value, 9), r.pos) for r in df.collect()}


@pytest.mark.parametrize("most", [1, 2, 3, 100])
def test_pearson_in_tiles(wide, monkeypatch, most):
    frame, df = wide
    numbers = [c for c in frame if c.startswith("n")]
    expected = frame[numbers].fillna(frame[numbers].mean()).corr().fillna(0.0)
    monkeypatch.setattr(association, "TILE_COLUMNS", most)
    got = values(pearson_pairs(df, numbers))
    pairs = [(a, b) for i, a in enumerate(numbers) for b in numbers[i + 1 :]]
    assert got == {(a, b): (pytest.approx(expected.loc[a, b], abs=1e-8), pos) for pos, (a, b) in enumerate(pairs)}


@pytest.mark.parametrize("cells", [1, 64, 300])
def test_cramers_v_in_tiles(wide, monkeypatch, cells):
    _, df = wide
    whole = values(cramers_v_pairs(df))
    assert sorted(pos for _, pos in whole.values()) == list(range(15)) and whole["s.4", "s.5"][0] == 1.0
    monkeypatch.setattr(association, "TILE_CELLS", cells)
    assert values(cramers_v_pairs(df)) == whole


def test_tiles_hold_each_pair_once():
    for sizes, most in (([3, 3, 3, 9, 1], 6), ([1] * 10, 4), ([5], 2)):
        groups = association._groups(sizes, most)
        assert [i for g in groups for i in g] == list(range(len(sizes)))
        assert all(len(g) == 1 or sum(sizes[i] for i in g) <= most for g in groups)
        tiles = association._tiles(sizes, most)
        pairs = [(i, j) for g, h in tiles for i in g for j in h if i < j]
        assert sorted(pairs) == [(i, j) for i in range(len(sizes)) for j in range(i + 1, len(sizes))]


def test_few_columns_and_no_rows(wide):
    _, df = wide
    assert pearson_pairs(df, ["n.0"]).count() == 0 and cramers_v_pairs(df, ["s.0"]).count() == 0
    none = df.where("false")
    assert {v for v, _ in values(pearson_pairs(none, ["n.0", "n.1", "n.2"])).values()} == {0.0}
    assert cramers_v_pairs(none, ["s.0", "s.1"]).count() == 0
