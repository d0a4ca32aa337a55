"""Exact interpolated quantiles that no single task has to hold.

Each quantile is narrowed: a sketch proposes a bracket, one counting pass proves how many
rows lie below, on and inside it, and the same pass sketches only the inside for
the next round. A bracket is resolved when the wanted rank falls on an end or few
rows are left inside. Every pass is a plain aggregate over the needed columns;
nothing shuffles but the aggregate buffers. The result never depends on the sketch
being right, as each bracket is checked by counting. Tables of all sizes take this way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.kinds import blocks
from ..functions.numbers import finite_view, not_nan
from ..functions.sql import number, quoted, rows, struct
from .tidy import union_all

INSIDE_ROWS = 50_000
GRID = 500
_BLOCK = 64
_SKETCHES = 5  # counted and sketched intervals a pass

Quantiles = dict[str, dict[float, float | None]]


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, Sequence[float]],
    value: Callable[[str], str] = not_nan,
    inside_rows: int | None = None,
) -> Quantiles:
    """{column: {p: quantile}} with linear interpolation; `value` picks the usable values."""
    wanted = {name: sorted(set(ps)) for name, ps in wanted.items() if ps}
    if not wanted:
        return {}
    found: Quantiles = {}
    for chunk in blocks(list(wanted), _BLOCK):
        part = {c: wanted[c] for c in chunk}
        view = finite_view(df, chunk, value=value)
        found |= _by_brackets(view, part, inside_rows or INSIDE_ROWS)
    return found


def _values(df: DataFrame, exprs: Sequence[str], block: int) -> list:
    """One value per aggregate; blocks of aggregates run side by side in one job."""
    parts = []
    for chunk in blocks(list(enumerate(exprs)), block):
        wide = df.selectExpr(*[f"{struct({'i': str(i), 'v': e})} AS a{i}" for i, e in chunk])
        parts.append(wide.selectExpr(rows([f"a{i}" for i, _ in chunk])))
    return [r["v"] for r in sorted(union_all(parts).collect(), key=lambda r: r["i"])]


def _array(values: Sequence[float]) -> str:
    return f"array({', '.join(map(number, values))})"


@dataclass(eq=False)
class _Bracket:
    """An interval proposed to hold the wanted ranks."""

    column: str
    p: float
    rows: int
    least: float
    most: float
    lo: float = 0.0
    hi: float = 0.0
    result: float | None = None

    def __post_init__(self) -> None:
        position = (self.rows - 1) * self.p
        self.low_rank = math.floor(position)
        self.high_rank = math.ceil(position)
        self.part = position - self.low_rank

    @property
    def x(self) -> str:
        return quoted(self.column)

    @property
    def inside(self) -> str:
        return f"{self.x} > {number(self.lo)} AND {self.x} < {number(self.hi)}"

    def finish(self, low: float, high: float) -> None:
        self.result = low if low == high else low + (high - low) * self.part

    def cell(self, grid: Sequence[float], below: int, count: int) -> tuple[float, float]:
        """Ends of the grid cells around the wanted ranks among `count` values."""
        first = math.floor((self.low_rank - below) / count * GRID) - 1
        last = math.ceil((self.high_rank - below + 1) / count * GRID) + 1
        return grid[max(first, 0)], grid[min(last, GRID)]


def _sketch(x: str) -> str:
    return f"percentile_approx({x}, {_array([i / GRID for i in range(GRID + 1)])}, {10 * GRID})"


def _by_brackets(df: DataFrame, wanted: dict[str, list[float]], inside_rows: int) -> Quantiles:
    stats = lambda x: struct({"n": f"count({x})", "lo": f"min({x})", "hi": f"max({x})", "grid": _sketch(x)})
    firsts = _values(df, [stats(quoted(c)) for c in wanted], _SKETCHES)
    found: Quantiles = {c: dict.fromkeys(ps) for c, ps in wanted.items()}
    pending: list[_Bracket] = []
    for i, (c, ps) in enumerate(wanted.items()):
        n, least, most, grid = firsts[i]
        for p in ps if n else ():
            b = _Bracket(c, p, n, least, most)
            b.lo, b.hi = b.cell(grid, 0, n)
            pending.append(b)
    while pending:
        still_open = _narrow(df, pending, inside_rows)
        for b in pending:
            if b not in still_open:
                found[b.column][b.p] = b.result
        pending = still_open
    return found


def _narrow(df: DataFrame, pending: Sequence[_Bracket], inside_rows: int) -> list[_Bracket]:
    """One counting and sketching pass; returns the brackets that stay open."""
    counts = lambda b: struct(
        {
            "below": f"count_if({b.x} < {number(b.lo)})",
            "on_lo": f"count_if({b.x} = {number(b.lo)})",
            "inside": f"count_if({b.inside})",
            "on_hi": f"count_if({b.x} = {number(b.hi)})",
            "grid": _sketch(f"CASE WHEN {b.inside} THEN {b.x} END"),
        }
    )
    counted = _values(df, [counts(b) for b in pending], _SKETCHES)
    still_open, listed = [], []
    for i, b in enumerate(pending):
        below, on_lo, inside, on_hi, grid = counted[i]
        start = below + on_lo
        end = start + inside
        top = end if b.lo == b.hi else end + on_hi
        if b.low_rank < below:  # the sketch missed: go on from the side proven by the count
            b.lo, b.hi = b.least, b.lo
            still_open.append(b)
        elif b.high_rank >= top:
            b.lo, b.hi = b.hi, b.most
            still_open.append(b)
        elif inside == 0 or b.high_rank < start or b.low_rank >= end:
            b.finish(b.lo if b.low_rank < start else b.hi, b.lo if b.high_rank < start else b.hi)
        elif inside <= inside_rows:
            listed.append((b, start, end))
        else:
            lo, hi = b.cell(grid, start, inside)
            b.lo = b.lo if b.low_rank < start else lo
            b.hi = b.hi if b.high_rank >= end else hi
            still_open.append(b)
    if listed:
        _pick(df, listed)
    return still_open


def _pick(df: DataFrame, listed: Sequence[tuple[_Bracket, int, int]]) -> None:
    """Read the ranked values out of the counted few a bracket still holds."""
    def ends(b: _Bracket, start: int, end: int) -> str:
        ranked = f"sort_array(collect_list(CASE WHEN {b.inside} THEN {b.x} END))"
        at = lambda rank: (
            number(b.lo) if rank < start else number(b.hi) if rank >= end else f"get({ranked}, {rank - start})"
        )
        return struct({"low": at(b.low_rank), "high": at(b.high_rank)})

    for (b, _, _), found in zip(listed, _values(df, [ends(*item) for item in listed], _SKETCHES)):
        b.finish(*found)
