"""Pearson and Cramér's V associations between columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import categorical_columns, numeric_columns, ref
from ..functions.numbers import finite_view, not_nan
from .tidy import per_column
from .value_counts import value_counts

MAX_CATEGORIES = 50
# Columns of each side of a tile of Pearson pairs, and cells of a tile of Cramér's V: bounds of what a task holds.
TILE_COLUMNS = 1000
TILE_CELLS = 32_000_000
PAIR_SCHEMA = "col_a string, col_b string, value double, pos int"


def _by_position(view: DataFrame) -> DataFrame:
    """The same columns named by their place: names with dots do not reach Python otherwise."""
    return view.toDF(*[f"c{i}" for i in range(len(view.columns))])


def _sums(view: DataFrame) -> DataFrame:
    """(i, n, s): count and sum of the values of each column by one scan; each task adds up its Arrow batches."""

    def run(batches):
        n = s = 0
        for batch in batches:
            with np.errstate(invalid="ignore", over="ignore"):
                s = s + np.array([c.fill_null(0.0).to_numpy(zero_copy_only=False).sum() for c in batch.columns])
            n = n + np.array([len(c) - c.null_count for c in batch.columns])
        if np.ndim(n):
            columns = [np.arange(len(n), dtype=np.int32), n.astype(np.int64), s]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "n", "s"])

    return _by_position(view).mapInArrow(run, "i int, n bigint, s double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _groups(sizes: Sequence[int], most: int) -> list[list[int]]:
    """Neighbouring places whose sizes add up to at most `most`; a larger one stands alone."""
    groups: list[list[int]] = []
    held = most
    for place, size in enumerate(sizes):
        if held + size > most or not groups:
            groups.append([])
            held = 0
        groups[-1].append(place)
        held += size
    return groups


def _tiles(sizes: Sequence[int], most: int) -> list[tuple[list[int], list[int]]]:
    """Pairs of groups that hold each pair of places once."""
    groups = _groups(sizes, most)
    return [(g, h) for i, g in enumerate(groups) for h in groups[i:]]


def _products(view: DataFrame, means: Sequence[float], left: list[int], right: list[int]) -> DataFrame:
    """(i, j, s) for i <= j of a tile: products of the deviations of two columns, a null is one of 0, summed by one scan.

    A task holds a number per pair of the tile and reads the columns of the tile.
    """
    own = left == right
    places = left if own else left + right
    centre = np.array([means[i] for i in places])

    def run(batches):
        s = None
        for batch in batches:
            x = np.column_stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns])
            given = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.where(given, x - centre, 0.0)
                part = x.T @ x if own else x[:, : len(left)].T @ x[:, len(left) :]
            s = part if s is None else s + part
        if s is not None:
            i, j = np.triu_indices(len(s)) if own else (k.ravel() for k in np.indices(s.shape))
            columns = [np.array(left, np.int32)[i], np.array(right, np.int32)[j], s[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "s"])

    names = view.columns
    return _by_position(view.select(*[ref(names[i]) for i in places])).mapInArrow(run, "i int, j int, s double")


def _united(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _named(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    """`pairs` with (col_a, col_b, pos) for the places i < j: both names, and the rank of the pair in their order."""
    n = len(names)
    table = F.broadcast(pairs.sparkSession.createDataFrame(list(enumerate(names)), "place int, name string"))  # a row per column
    for place, name in (("i", "col_a"), ("j", "col_b")):
        pairs = pairs.join(table.select(F.col("place").alias(place), F.col("name").alias(name)), place)
    return pairs.withColumn("pos", F.expr(f"CAST(CAST(i AS BIGINT) * {n} - CAST(i AS BIGINT) * (i + 1) div 2 + j - i - 1 AS INT)"))


def pearson_pairs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, value, pos) for all pairs of numeric columns; nulls count as the mean.

    A scan for the means and one for the sums of products of deviations; beyond `TILE_COLUMNS` columns one for each tile, which
    reads the columns of the tile only. The driver holds a row per column, never per pair.
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], PAIR_SCHEMA)
    view = finite_view(df, cols, value=not_nan)
    found = {r["i"]: r["s"] / r["n"] for r in _sums(view).collect() if r["n"]}  # a row per column
    means = [found.get(i, 0.0) for i in range(len(cols))]
    parts = [_products(view, means, left, right) for left, right in _tiles([1] * len(cols), TILE_COLUMNS)]
    sums = _united(parts).groupBy("i", "j").agg(F.sum("s").alias("s"))
    own = F.max(F.expr("CASE WHEN i = j THEN sqrt(s) END"))  # windows hold a row per column
    scaled = sums.withColumns({f"root_{end}": own.over(Window.partitionBy(end)) for end in ("i", "j")}).where("i < j")
    r = F.expr("coalesce(nanvl(try_divide(s, root_i * root_j), 0.0D), 0.0D)")
    pairs = spark.range(len(cols) - 1).selectExpr("CAST(id AS INT) AS i", f"explode(sequence(CAST(id AS INT) + 1, {len(cols) - 1})) AS j")
    return _named(pairs.join(scaled, ["i", "j"], "left"), cols).select("col_a", "col_b", r.alias("value"), "pos")


def categories_of(df: DataFrame, cols: Sequence[str], limit: int = MAX_CATEGORIES) -> dict[str, list]:
    """The distinct non-null values of the columns that have at most `limit` of them, counted exactly."""
    if not cols:
        return {}
    counts = value_counts(df, cols)
    sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    few = [r["column"] for r in sizes.where(F.col("n") <= limit).collect()]
    values = counts.where(F.col("column").isin(few)).select("column", "value").collect() if few else []  # limit a column
    return {c: sorted(r["value"] for r in values if r["column"] == c) for c in cols if c in set(few)}


def low_cardinality(df: DataFrame, cols: Sequence[str], limit: int = MAX_CATEGORIES) -> dict[str, list]:
    """The values of the columns with at most `limit` distinct ones; a column without any value is one of them."""
    known = categories_of(df, cols, limit)
    rest = [c for c in cols if c not in known]
    counts = per_column(df, rest, lambda c, x: {"n": f"count({x})"}).where("n = 0").collect() if rest else []
    empty = {r["column"] for r in counts}
    return {c: known.get(c, []) for c in cols if c in known or c in empty}


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, cnt) of rows where both hold a value, in long form."""
    kept = df.where(ref(a).isNotNull() & ref(b).isNotNull())
    return kept.groupBy(ref(a).alias("a"), ref(b).alias("b")).agg(F.count(F.lit(1)).alias("cnt"))


def _contingency(df: DataFrame, known: dict[str, list], left: list[int], right: list[int]) -> DataFrame:
    """(i, j, a, b, cnt): the tables of the pairs i < j of a tile by one scan. A task counts coded pairs, so no row is
    repeated for each pair; it holds the cells of the tile."""
    names = list(known)
    cols = [names[i] for i in sorted({*left, *right})]
    values = [pa.array(known[c], pa.string()) for c in cols]
    at = {i: cols.index(names[i]) for i in {*left, *right}}
    places = [((i, j), at[i], at[j]) for i in left for j in right if i < j]

    def run(batches):
        held = {pos: 0 for pos, _, _ in places}
        for batch in batches:
            codes = [
                pc.fill_null(pc.index_in(c.cast(pa.string()), v), len(v)).to_numpy(zero_copy_only=False).astype(np.int64)
                for c, v in zip(batch.columns, values)
            ]
            for pos, a, b in places:
                wide = len(values[b]) + 1
                held[pos] = held[pos] + np.bincount(codes[a] * wide + codes[b], minlength=(len(values[a]) + 1) * wide)
        for pos, a, b in places:
            cells = np.reshape(held[pos], (len(values[a]) + 1, -1))[:-1, :-1] if np.ndim(held[pos]) else np.zeros((0, 0), np.int64)
            i, j = np.nonzero(cells)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.full(len(i), place, np.int32)) for place in pos), values[a].take(pa.array(i)), values[b].take(pa.array(j)), pa.array(cells[i, j].astype(np.int64))],
                names=["i", "j", "a", "b", "cnt"],
            )

    return _by_position(df.select(*[ref(c) for c in cols])).mapInArrow(run, "i int, j int, a string, b string, cnt bigint")


def cramers_v_pairs(
    df: DataFrame, cols: Sequence[str] | None = None, limit: int = MAX_CATEGORIES
) -> DataFrame:
    """(col_a, col_b, value, pos) for pairs of string columns of few categories.

    With both columns capped at `limit` categories a pair holds at most limit²
    cells, so the marginal windows run over small groups. One scan counts all pairs; beyond `TILE_CELLS` cells there is one
    for each tile, which reads the columns of the tile only.
    """
    cols = categorical_columns(df) if cols is None else list(cols)
    known = low_cardinality(df, cols, limit)
    if len(known) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    tiles = _tiles([len(v) + 1 for v in known.values()], math.isqrt(TILE_CELLS))
    parts = [_contingency(df, known, left, right) for left, right in tiles if len({*left, *right}) > 1]
    cells = _united(parts).groupBy("i", "j", "a", "b").agg(F.sum("cnt").alias("cnt"))
    row_sum = F.sum("cnt").over(Window.partitionBy("i", "j", "a"))
    col_sum = F.sum("cnt").over(Window.partitionBy("i", "j", "b"))
    sized = cells.withColumn("r", row_sum).withColumn("c", col_sum)
    share = F.col("cnt") * F.col("cnt") / (F.col("r").cast("double") * F.col("c"))
    per_pair = sized.groupBy("i", "j").agg(
        F.sum(share).alias("s"),
        F.count_distinct("a").alias("n_a"),
        F.count_distinct("b").alias("n_b"),
    )
    narrow = F.least("n_a", "n_b") - 1
    # The sum of o²/(r·c) is 1 + chi²/n; rounding may push it a hair below 1.
    v = F.coalesce(F.sqrt(F.try_divide(F.greatest(F.col("s") - 1, F.lit(0.0)), narrow)), F.lit(0.0))
    return _named(per_pair, list(known)).select("col_a", "col_b", v.alias("value"), "pos")


def top_pairs(pearson: DataFrame, cramers: DataFrame, n: int = 5) -> DataFrame:
    """The strongest pairs of both kinds; ties keep Pearson first, then column order."""
    tag = lambda pairs, method, rank: pairs.withColumn("method", F.lit(method)).withColumn("kind", F.lit(rank))
    both = tag(pearson, "pearson", 0).unionByName(tag(cramers, "cramers_v", 1))
    strength = F.abs(F.round("value", 4))
    return (
        both.orderBy(strength.desc(), "kind", "pos")
        .limit(n)
        .select("col_a", "col_b", "method", "value")
    )
