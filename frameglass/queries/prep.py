"""Queries over column operations and their chains."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from ..operators.prep import (
    CustomTransform,
    DropColumns,
    DropNullRows,
    EncodeLabel,
    EncodeOneHot,
    EncodeOrdinal,
    ImputeConstant,
    ImputeMean,
    ImputeMedian,
    ImputeMode,
    Operation,
    OutlierIQR,
    OutlierZScore,
    PandasTransform,
    PercentileClip,
    ScaleMinMax,
    ScaleRobust,
    ScaleStandard,
)
from ..plans.chain import Chain
from ..session import scratch_path
from ..streaming import score_available
from .common import PLANTED_SQL, ROW_DIGITS, Query, fences_sql, planted_lines, rounded_rows, table

# The pandas step below travels with its task, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_P = f"WITH p AS ({PLANTED_SQL}) "
_NUM = "CAST({c} AS DOUBLE)"
_REST = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _on_planted(name: str, step, select: str, where: str = "", source: str = "p", cols: str = "") -> None:
    """A query that fits `step()` on the planted lines and transforms them."""
    def run(spark, sf):
        lines = planted_lines(spark, sf)
        if cols:
            lines = lines.select(*[c.strip() for c in cols.split(",")])
        operation: Operation = step()
        return rounded_rows(operation.fit(lines).transform(lines))

    QUERIES[name] = run
    ORACLE[name] = _P + f"SELECT {select} FROM {source}{' WHERE ' + where if where else ''}"


_C2 = f"{_REST}, l_discount, l_extendedprice, l_line"
_TARGETS = ["l_discount", "l_extendedprice", "l_line"]


def _each(template: str) -> str:
    return ", ".join(f"round({template.format(c=c, x=f'CAST({c} AS DOUBLE)')}, {ROW_DIGITS}) AS {c}" for c in _TARGETS)


_on_planted(
    "impute_mean", lambda: ImputeMean(_TARGETS),
    f"{_REST}, " + _each("coalesce({x}, (SELECT avg({c}) FROM p))"), cols=_C2,
)
_on_planted(
    "impute_median", lambda: ImputeMedian(_TARGETS),
    f"{_REST}, " + _each("coalesce({x}, (SELECT quantile_cont({x}, 0.5) FROM p))"), cols=_C2,
)

_MODE = "(SELECT {c} FROM p WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
_MODE_COLS = ["l_returnflag", "l_linestatus", "l_line", "l_discount"]
_on_planted(
    "impute_mode", lambda: ImputeMode(_MODE_COLS),
    f"{_REST}, " + ", ".join(f"coalesce({c}, {_MODE.format(c=c)}) AS {c}" for c in _MODE_COLS),
    cols=f"{_REST}, {', '.join(_MODE_COLS)}",
)
_on_planted(
    "impute_constant",
    lambda: ImputeConstant({"l_returnflag": "unknown", "l_line": -1, "l_discount": 0.5}, ["l_returnflag", "l_line", "l_discount", "l_linestatus"]),
    f"{_REST}, coalesce(l_returnflag, 'unknown') AS l_returnflag, coalesce(l_line, -1) AS l_line, "
    "coalesce(l_discount, CAST(0.5 AS DOUBLE)) AS l_discount, l_linestatus",
    cols=f"{_REST}, l_returnflag, l_line, l_discount, l_linestatus",
)
_on_planted(
    "drop_null_rows", lambda: DropNullRows(["l_discount", "l_returnflag"]), f"{_REST}, l_discount, l_returnflag, l_line",
    "l_discount IS NOT NULL AND l_returnflag IS NOT NULL", cols=f"{_REST}, l_discount, l_returnflag, l_line",
)
_on_planted(
    "prep_drop_columns", lambda: DropColumns(["l_line", "l_returnflag"]), f"{_REST}, l_quantity, l_discount, l_extendedprice, l_linestatus",
)

# Outliers need a spread: a product of the planted columns, null where a factor is.
_DUTY = "SELECT *, l_discount * l_extendedprice AS duty, l_quantity * l_quantity * l_quantity AS cube FROM p"
_W = _P[:-1] + f", w AS ({_DUTY}) "
_DUTY_COLS = f"{_REST}, duty, cube"


def _on_duty(name: str, step, select: str, where: str = "", source: str = "w") -> None:
    def run(spark, sf):
        lines = spark.sql(_DUTY.replace("FROM p", "FROM {p}"), p=planted_lines(spark, sf))
        lines = lines.select(*[c.strip() for c in _DUTY_COLS.split(",")])
        return rounded_rows(step().fit(lines).transform(lines))

    QUERIES[name] = run
    ORACLE[name] = _W + f"SELECT {select} FROM {source}{' WHERE ' + where if where else ''}"


_CLIP = "round(CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END, " + f"{ROW_DIGITS}) AS " + "{c}"
_FENCED = (
    f"w, (SELECT lower_fence AS d_lo, upper_fence AS d_hi FROM ({fences_sql('duty', 'w')}) a) fd, "
    f"(SELECT lower_fence AS c_lo, upper_fence AS c_hi FROM ({fences_sql('cube', 'w')}) b) fc"
)
_clips = f"{_REST}, " + _CLIP.format(c="duty", lo="d_lo", hi="d_hi") + ", " + _CLIP.format(c="cube", lo="c_lo", hi="c_hi")
_inside = "NOT coalesce(duty < d_lo OR duty > d_hi, FALSE) AND NOT coalesce(cube < c_lo OR cube > c_hi, FALSE)"
_plain = f"{_REST}, round(duty, {ROW_DIGITS}) AS duty, round(cube, {ROW_DIGITS}) AS cube"

_on_duty("outlier_iqr_clip", lambda: OutlierIQR("clip", ["duty", "cube"]), _clips, source=_FENCED)
_on_duty("outlier_iqr_drop", lambda: OutlierIQR("drop", ["duty", "cube"]), _plain, _inside, _FENCED)

_Z = (
    "w, (SELECT avg(duty) - 1.5 * stddev_samp(duty) AS d_lo, avg(duty) + 1.5 * stddev_samp(duty) AS d_hi, "
    "avg(cube) - 1.5 * stddev_samp(cube) AS c_lo, avg(cube) + 1.5 * stddev_samp(cube) AS c_hi FROM w) z"
)
_on_duty("outlier_zscore_clip", lambda: OutlierZScore(1.5, "clip", ["duty", "cube"]), _clips, source=_Z)
_on_duty("outlier_zscore_drop", lambda: OutlierZScore(1.5, "drop", ["duty", "cube"]), _plain, _inside, _Z)
_PCT = (
    "w, (SELECT quantile_cont(duty, 0.05) AS d_lo, quantile_cont(duty, 0.95) AS d_hi, "
    "quantile_cont(cube, 0.05) AS c_lo, quantile_cont(cube, 0.95) AS c_hi FROM w) z"
)
_on_duty("percentile_clip", lambda: PercentileClip(0.05, 0.95, ["duty", "cube"]), _clips, source=_PCT)


# Scaling also shows a constant column, where nulls are overwritten.
_FLAT = "SELECT *, CASE WHEN l_discount IS NULL THEN NULL ELSE 7 END AS flat FROM p"
_F = _P[:-1] + f", w AS ({_FLAT}) "
_SCALED = ["l_discount", "l_extendedprice", "l_quantity", "flat"]


def _on_flat(name: str, step, template: str, flat: str, stats: str) -> None:
    def run(spark, sf):
        lines = spark.sql(_FLAT.replace("FROM p", "FROM {p}"), p=planted_lines(spark, sf))
        lines = lines.select(*[c.strip() for c in _REST.split(",")], *_SCALED)
        return rounded_rows(step().fit(lines).transform(lines))

    QUERIES[name] = run
    scaled = ", ".join(f"round({template.format(c=c)}, {ROW_DIGITS}) AS {c}" for c in _SCALED[:3])
    parts = ", ".join(f"{stats.format(c=c)}" for c in _SCALED[:3])
    ORACLE[name] = _F + f"SELECT {_REST}, {scaled}, CAST({flat} AS DOUBLE) AS flat FROM w, (SELECT {parts} FROM w) s"


_on_flat("scale_minmax", lambda: ScaleMinMax((-1.0, 1.0), _SCALED), "({c} - {c}_lo) / ({c}_hi - {c}_lo) * 2 - 1", "-1",
         "min({c}) AS {c}_lo, max({c}) AS {c}_hi")
_on_flat("scale_standard", lambda: ScaleStandard(_SCALED), "({c} - {c}_m) / {c}_s", "0",
         "avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s")
_on_flat("scale_robust", lambda: ScaleRobust(_SCALED), "({c} - {c}_m) / ({c}_b - {c}_a)", "0",
         "quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.75) AS {c}_b")

# --- encoding -----------------------------------------------------------------------

_on_planted(
    "encode_onehot", lambda: EncodeOneHot(["l_returnflag", "l_linestatus"]),
    f"{_REST}, " + ", ".join(
        f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS {c}_{v}"
        for c, vs in (("l_returnflag", "ANR"), ("l_linestatus", "FO")) for v in vs
    ),
    cols=f"{_REST}, l_returnflag, l_linestatus",
)
_on_planted(
    "encode_ordinal", lambda: EncodeOrdinal({"l_returnflag": ["N", "R"]}, ["l_returnflag", "l_linestatus"]),
    f"{_REST}, CASE l_returnflag WHEN 'N' THEN CAST(0 AS BIGINT) WHEN 'R' THEN 1 END AS l_returnflag, "
    "CASE l_linestatus WHEN 'F' THEN CAST(0 AS BIGINT) WHEN 'O' THEN 1 END AS l_linestatus",
    cols=f"{_REST}, l_returnflag, l_linestatus",
)


def _label(spark, sf):
    # Customer names exceed the listed categories, so they take the distributed ranking.
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_totalprice > 450000 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
        "concat('C', CAST(o_custkey AS STRING)) AS customer",
    )
    return EncodeLabel(["o_orderpriority", "customer"]).fit(orders).transform(orders)


QUERIES["encode_label"] = _label
ORACLE["encode_label"] = (
    "WITH o AS (SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN NULL ELSE o_orderpriority END AS o_orderpriority, "
    "'C' || o_custkey AS customer FROM orders), "
    "a AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS k FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1), "
    "b AS (SELECT customer AS v, row_number() OVER (ORDER BY customer) - 1 AS k FROM o GROUP BY 1) "
    "SELECT o_orderkey, a.k AS o_orderpriority, b.k AS customer FROM o LEFT JOIN a ON o.o_orderpriority = a.v LEFT JOIN b ON o.customer = b.v"
)


def _sparse(spark, sf):
    # Customers exceed what a driver lists, priorities do not.
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_totalprice > 450000 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
        "concat('C', CAST(o_custkey AS STRING)) AS customer",
    )
    coded = EncodeOneHot(["o_orderpriority", "customer"], form="sparse").fit_transform(orders)
    return coded.selectExpr(
        "o_orderkey", "o_orderpriority_onehot.size AS priorities", "get(o_orderpriority_onehot.indices, 0) AS priority",
        "customer_onehot.size AS customers", "get(customer_onehot.indices, 0) AS customer", "get(customer_onehot.values, 0) AS hot",
    )


QUERIES["encode_onehot_sparse"] = _sparse
ORACLE["encode_onehot_sparse"] = (
    "SELECT o_orderkey, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_totalprice <= 450000) AS priorities, "
    "o_orderpriority AS priority, (SELECT count(DISTINCT o_custkey) FROM orders) AS customers, customer, 1 AS hot "
    f"FROM ({ORACLE['encode_label']}) coded"
)

# --- custom steps, chains, streams --------------------------------------------------

_NET = f"l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), {ROW_DIGITS}) AS net"


def _add_net(df):
    return df.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice * (1 - l_discount) AS net")


def _net_batches(batch):
    out = batch[["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]].copy()
    out["net"] = batch["l_extendedprice"] * (1 - batch["l_discount"])
    return out


QUERIES["custom_transform"] = lambda spark, sf: rounded_rows(
    CustomTransform(_add_net).fit_transform(table(spark, sf, "lineitem"))
)
ORACLE["custom_transform"] = f"SELECT {_NET} FROM lineitem"


def _custom_pandas(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"
    )
    schema = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, net double"
    return rounded_rows(PandasTransform(_net_batches, schema).fit_transform(lines))


QUERIES["custom_transform_pandas"] = _custom_pandas
ORACLE["custom_transform_pandas"] = ORACLE["custom_transform"]

_STEPS = [
    {"operation": "missing", "strategy": {"type": "median"}, "cols": ["l_extendedprice", "l_discount"]},
    {"operation": "outlier", "strategy": {"type": "zscore", "threshold": 1.5, "action": "drop"}, "cols": ["l_extendedprice"]},
    {"operation": "scaling", "strategy": {"type": "standard"}, "cols": ["l_extendedprice", "l_discount"]},
    {"operation": "encoding", "strategy": {"type": "label"}, "cols": ["l_returnflag"]},
]
_CHAIN_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag"]
_FILLED = (
    ", m AS (SELECT quantile_cont(l_extendedprice, 0.5) AS em, quantile_cont(l_discount, 0.5) AS dm FROM p), "
    "f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(l_extendedprice, em) AS e, "
    "coalesce(l_discount, dm) AS d, l_returnflag FROM p, m)"
)
_SCALED_OUT = (
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((e - e_m) / e_s, {ROW_DIGITS}) AS l_extendedprice, "
    f"round((d - d_m) / d_s, {ROW_DIGITS}) AS l_discount, CASE l_returnflag WHEN 'A' THEN CAST(0 AS BIGINT) WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS l_returnflag "
)


def _chain_lines(spark, sf):
    return planted_lines(spark, sf).select(*_CHAIN_COLS)


QUERIES["fit_transform_chain"] = lambda spark, sf: rounded_rows(
    Chain.from_steps(_STEPS).fit_transform(_chain_lines(spark, sf))
)
ORACLE["fit_transform_chain"] = _P[:-1] + _FILLED + (
    ", z AS (SELECT avg(e) AS zm, stddev_samp(e) AS zs FROM f), g AS (SELECT f.* FROM f, z WHERE abs((e - zm) / zs) <= 1.5), "
    "s AS (SELECT avg(e) AS e_m, stddev_samp(e) AS e_s, avg(d) AS d_m, stddev_samp(d) AS d_s FROM g) "
    + _SCALED_OUT + "FROM g, s"
)

# Here every step is fitted on the raw input, nulls included.
_RAW_FIT = _P[:-1] + _FILLED + (
    ", s AS (SELECT avg(l_extendedprice) AS e_m, stddev_samp(l_extendedprice) AS e_s, avg(l_discount) AS d_m, "
    "stddev_samp(l_discount) AS d_s FROM p) " + _SCALED_OUT + "FROM f, s WHERE abs((e - e_m) / e_s) <= 1.5"
)


def _fit_then_transform(spark, sf):
    lines = _chain_lines(spark, sf)
    return rounded_rows(Chain.from_steps(_STEPS).fit(lines).transform(lines))


def _persisted(spark, sf):
    lines = _chain_lines(spark, sf)
    path = scratch_path(spark, "chain")
    Chain.from_steps(_STEPS).fit(lines).save(spark, path)
    return rounded_rows(Chain.load(spark, path).transform(lines))


QUERIES["fit_then_transform_chain"] = _fit_then_transform
ORACLE["fit_then_transform_chain"] = _RAW_FIT
QUERIES["persisted_chain"] = _persisted
ORACLE["persisted_chain"] = _RAW_FIT


def _stream(spark, sf):
    orders = table(spark, sf, "orders")
    chain = Chain(
        [ScaleStandard(["o_totalprice"]), EncodeLabel(["o_orderpriority"])]
    ).fit(orders)
    scored = score_available(
        spark, chain, f"{sf}/orders*.parquet", orders.schema, scratch_path(spark, "scored")
    )
    return rounded_rows(scored.select("o_orderkey", "o_totalprice", "o_orderpriority"))


QUERIES["apply_to_stream"] = _stream
ORACLE["apply_to_stream"] = (
    f"SELECT o_orderkey, round((o_totalprice - m) / s, {ROW_DIGITS}) AS o_totalprice, k AS o_orderpriority FROM orders "
    "JOIN (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS k FROM orders GROUP BY 1) c "
    "ON o_orderpriority = v, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) t"
)
