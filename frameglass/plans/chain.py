"""Chains of column operations: build, fit, apply, save and load."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import prep
from ..operators.prep.base import Needs, Operation, collect_stats
from ..operators.prep.categories import Categories

_BUILDERS = {
    ("missing", "mean"): lambda s, c: prep.ImputeMean(c),
    ("missing", "median"): lambda s, c: prep.ImputeMedian(c),
    ("missing", "mode"): lambda s, c: prep.ImputeMode(c),
    ("missing", "constant"): lambda s, c: prep.ImputeConstant(s.get("fill_value", 0), c),
    ("missing", "drop_row"): lambda s, c: prep.DropNullRows(c),
    ("missing", "drop_col"): lambda s, c: prep.DropColumns(c),
    ("encoding", "onehot"): lambda s, c: prep.EncodeOneHot(c, s.get("max_categories"), s.get("form", "columns")),
    ("encoding", "ordinal"): lambda s, c: prep.EncodeOrdinal(s.get("order"), c),
    ("encoding", "label"): lambda s, c: prep.EncodeLabel(c),
    ("outlier", "iqr"): lambda s, c: prep.OutlierIQR(s.get("action", "clip"), c),
    ("outlier", "zscore"): lambda s, c: prep.OutlierZScore(s.get("threshold", 3.0), s.get("action", "clip"), c),
    ("outlier", "percentile_clip"): lambda s, c: prep.PercentileClip(s.get("lower", 0.05), s.get("upper", 0.95), c),
    ("scaling", "minmax"): lambda s, c: prep.ScaleMinMax(s.get("feature_range", (0.0, 1.0)), c),
    ("scaling", "standard"): lambda s, c: prep.ScaleStandard(c),
    ("scaling", "robust"): lambda s, c: prep.ScaleRobust(c),
    ("custom", "function"): lambda s, c: prep.CustomTransform(s["fn"]),
    ("custom", "sql"): lambda s, c: prep.SqlTransform(s["exprs"]),
    ("custom", "pandas"): lambda s, c: prep.PandasTransform(s["fn"], s["schema"]),
}

PARAMS_SCHEMA = "step int, op string, column string, param string, value string"
_CODES = "codes"


def build_operation(operation: str, strategy: Mapping[str, Any], cols: Sequence[str] | None) -> Operation:
    try:
        build = _BUILDERS[operation, strategy["type"]]
    except KeyError:
        raise ValueError(f"unknown operation {operation!r} with strategy {strategy.get('type')!r}") from None
    return build(strategy, None if cols is None else list(cols))


def _plain(value: Any) -> Any:
    if isinstance(value, (date, datetime)):
        return {"time": value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat()}
    if isinstance(value, Mapping):
        return {k: _plain(v) for k, v in value.items()}
    return value


def _restored(value: Any) -> Any:
    if isinstance(value, dict):
        return value["time"] if set(value) == {"time"} else {k: _restored(v) for k, v in value.items()}
    return value


class Chain:
    """Operations applied in order."""

    def __init__(self, steps: Iterable[Operation] = ()) -> None:
        self.steps = list(steps)

    @classmethod
    def from_steps(cls, steps: Sequence[Mapping[str, Any]]) -> Chain:
        """Build from `{operation, strategy: {type, …}, cols}` mappings."""
        if not steps:
            raise ValueError("steps must not be empty")
        return cls(build_operation(s["operation"], s["strategy"], s.get("cols")) for s in steps)

    def add(self, operation: Operation) -> Chain:
        self.steps.append(operation)
        return self

    def fit(self, df: DataFrame) -> Chain:
        """Fit every step on the raw input; all steps share one collection of statistics."""
        asked = [step.prepare(df) for step in self.steps]
        stats = collect_stats(df, reduce(Needs.merge, (needs for _, needs in asked), Needs()))
        for step, (cols, _) in zip(self.steps, asked):
            step.learn(cols, stats)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Fit every step on the output of the one before; unlike `fit` then `transform`."""
        for step in self.steps:
            df = step.fit_transform(df)
        return df

    def params_table(self, spark: SparkSession) -> DataFrame:
        """(step, op, column, param, value): options have no column, values are JSON."""
        return spark.createDataFrame(self._param_rows(), PARAMS_SCHEMA)

    def _param_rows(self) -> list[tuple]:
        rows = []
        for i, step in enumerate(self.steps):
            if isinstance(step, (prep.CustomTransform, prep.PandasTransform)):
                raise ValueError(f"step {i} ({step.name}) holds Python code and cannot be saved")
            if step.params is None:
                raise RuntimeError(f"{type(step).__name__} is not fitted yet")
            for key, value in {**step.options(), "cols": step.cols}.items():
                rows.append((i, step.name, None, key, json.dumps(_plain(value))))
            for column, params in step.params.items():
                rows.append((i, step.name, column, "fitted", "true"))
                for key, value in params.items():
                    if isinstance(value, Categories):
                        value = {"values": value.values, "table": value.table is not None, "rows": value.rows, "bytes": value.bytes}
                    rows.append((i, step.name, column, key, json.dumps(_plain(value))))
        return rows

    def save(self, spark: SparkSession, path: str) -> None:
        """The params as a small Parquet table, large code tables as folders beside it."""
        root = path.rstrip("/")
        self.params_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{root}/params")
        for i, step in enumerate(self.steps):
            for n, params in enumerate((step.params or {}).values()):
                known = params.get("categories")
                if isinstance(known, Categories) and known.table is not None:
                    known.table.write.mode("overwrite").parquet(f"{root}/{_CODES}/{i}-{n}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Chain:
        root = path.rstrip("/")
        # One row per option and column parameter of the chain.
        rows = spark.read.parquet(f"{root}/params").collect()
        by_step: dict[int, list] = {}
        for row in rows:
            by_step.setdefault(row["step"], []).append(row)
        chain = cls()
        for i in sorted(by_step):
            own = by_step[i]
            options = {r["param"]: json.loads(r["value"]) for r in own if r["column"] is None}
            options = {k: _restored(v) for k, v in options.items()}
            kind, strategy = own[0]["op"].split(".")
            step = build_operation(kind, {**options, "type": strategy}, options.pop("cols"))
            step.params = {}
            for r in own:
                if r["column"] is not None:
                    slot = step.params.setdefault(r["column"], {})
                    if r["param"] != "fitted":
                        slot[r["param"]] = _restored(json.loads(r["value"]))
            for n, slot in enumerate(step.params.values()):
                known = slot.get("categories")
                if isinstance(known, dict):
                    table = spark.read.parquet(f"{root}/{_CODES}/{i}-{n}") if known["table"] else None
                    slot["categories"] = Categories(known["values"], table, known["rows"], known["bytes"])
            chain.add(step)
        return chain

    def __repr__(self) -> str:
        return f"Chain({' > '.join(map(repr, self.steps))})"
