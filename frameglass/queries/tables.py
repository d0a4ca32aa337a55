"""Queries over sources, sinks, projections, schema, missing values and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kinds import categorical_columns, numeric_columns
from ..functions.numbers import finite_view
from ..operators.duplicates import duplicate_rows
from ..operators.schema import column_types, logical_size, null_counts, table_shape
from ..operators.first_seen import first_values
from ..operators.value_counts import n_unique
from ..session import scratch_path
from ..sources import (
    clean_preview,
    corrupt_rows,
    infer_column_kinds,
    null_safe,
    preview,
    read_any,
    read_csv,
    read_json,
    read_jsonl,
    read_parquet,
    source_meta,
    validate_source,
    write_clean,
)
from .common import LINE_KEY, LINE_NUMBERS, PLANTED_SQL, Query, planted_lines, rounded, table, union_sql

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


# --- sources and sinks -------------------------------------------------------------

@query(
    "read_csv",
    "SELECT o_orderkey, CASE WHEN o_custkey > 500 THEN o_custkey END AS o_custkey, "
    "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus, o_totalprice, "
    "strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, "
    "'say \"' || o_orderpriority || '\",' || chr(10) || 'end' AS note, o_totalprice > 100000 AS big FROM orders",
)
def _(spark, sf):
    out = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_custkey > 500 THEN o_custkey END AS o_custkey",
        "CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE o_orderstatus END AS o_orderstatus",
        "o_totalprice",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS o_orderdate",
        "concat('say \"', o_orderpriority, '\",\n', 'end') AS note",
        "o_totalprice > 100000 AS big",
    )
    path = f"{scratch_path(spark, 'csv')}.csv"
    out.write.options(header=True, escape='"').csv(path)
    return read_csv(spark, path)


@query(
    "read_csv_blocks",
    "SELECT doc_id, CASE WHEN text <> '' THEN text END AS text, lang, "
    "'a \"' || source || '\",' || chr(10) || chr(10) || '\"' || lang AS note FROM documents",
)
def _(spark, sf):
    # Whole texts with their line breaks and quotes: lines, records and blocks end anywhere in them.
    out = table(spark, sf, "documents").selectExpr(
        "doc_id", "text", "lang", "concat('a \"', source, '\",\n\n\"', lang) AS note"
    )
    path = f"{scratch_path(spark, 'csv')}.csv"
    out.write.options(header=True, escape='"', quoteAll=True).csv(path)
    return read_csv(spark, path, staged=True)


@query(
    "read_json",
    "SELECT o_orderkey, o_custkey AS \"customer.key\", o_orderpriority AS \"customer.rank.name\", o_totalprice, "
    "'[\"' || o_orderstatus || '\", \"' || o_orderpriority || '\"]' AS tags FROM orders",
)
def _(spark, sf):
    # Documents of at most 1000 orders each, by key range: no document grows with the table.
    docs = (
        table(spark, sf, "orders")
        .selectExpr(
            "o_orderkey div 1000 AS chunk",
            "struct(o_orderkey, struct(o_custkey AS key, struct(o_orderpriority AS name) AS rank) AS customer, "
            "o_totalprice, array(o_orderstatus, o_orderpriority) AS tags) AS item",
        )
        .groupBy("chunk")
        .agg(F.collect_list("item").alias("orders"))
    )
    path = f"{scratch_path(spark, 'json')}.json"
    docs.selectExpr("to_json(struct(chunk, orders))").write.option("maxRecordsPerFile", 1).text(path)
    return read_json(spark, path)


@query(
    "read_json_blocks",
    "SELECT doc_id, text AS \"body.text\", source AS \"body.at\", '[\"' || lang || '\", \"}],{\"]' AS tags FROM documents",
)
def _(spark, sf):
    # A root array of whole texts for each part of the table, with the signs of JSON in strings. No line break ends an item.
    items = table(spark, sf, "documents").selectExpr(
        "to_json(struct(doc_id, struct(text, source AS at) AS body, array(lang, '}],{') AS tags)) AS item",
        "spark_partition_id() AS part", "monotonically_increasing_id() AS at",
    )
    first, last = "row_number() OVER (PARTITION BY part ORDER BY at)", "row_number() OVER (PARTITION BY part ORDER BY at DESC)"
    lines = items.selectExpr("item", f"{first} AS i", f"{last} AS j", "part", "at").repartition("part").sortWithinPartitions("part", "at")
    path = f"{scratch_path(spark, 'json')}.json"
    lines.selectExpr("concat(if(i = 1, '[', ','), item, if(j = 1, ']', ''))", "part").write.partitionBy("part").option("lineSep", " ").text(path)
    return read_json(spark, f"{path}/part=*", staged=True)


@query(
    "read_jsonl",
    "SELECT event_id, event_type AS \"payload.type\", value AS \"payload.value\", "
    "CASE WHEN event_type = 'error' THEN user_id END AS \"error.code\", "
    "'[' || user_id || ', ' || event_id || ']' AS ids FROM events",
)
def _(spark, sf):
    lines = table(spark, sf, "events").selectExpr(
        "to_json(struct(event_id, struct(event_type AS type, value) AS payload, "
        "CASE WHEN event_type = 'error' THEN struct(user_id AS code, CAST(NULL AS STRING) AS msg) END AS error, "
        "array(user_id, event_id) AS ids, CAST(NULL AS STRING) AS never), map('ignoreNullFields', 'false')) AS line"
    )
    path = f"{scratch_path(spark, 'jsonl')}.jsonl"
    lines.write.text(path)
    return read_jsonl(spark, path)


@query("read_parquet", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    return read_parquet(spark, f"{sf}/customer.parquet")


@query("read_any", "SELECT count(*) AS n_rows, min(p_name) AS first_name, max(p_size) AS largest FROM part")
def _(spark, sf):
    return read_any(spark, f"{sf}/part.parquet").selectExpr(
        "count(1) AS n_rows", "min(p_name) AS first_name", "max(p_size) AS largest"
    )


@query("source_meta", "SELECT 'lineitem.parquet' AS source, '.parquet' AS file_format, count(*) AS n_rows FROM lineitem")
def _(spark, sf):
    return source_meta(table(spark, sf, "lineitem")).select("source", "file_format", "n_rows")


@query(
    "validate_source",
    "SELECT count(*) AS n_rows, count(*) FILTER (WHERE value > 100) AS n_corrupt, "
    "count(*) FILTER (WHERE value <= 100) AS n_filled, 'accepted' AS parquet FROM events",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    lines = events.selectExpr(
        "CASE WHEN value > 100 THEN concat('{\"event_id\": ', event_id, ', \"value') "
        "ELSE to_json(struct(event_id, value)) END AS line"
    )
    path = f"{scratch_path(spark, 'probe')}.jsonl"
    lines.write.text(path)
    validate_source(spark, f"{sf}/events.parquet")
    return corrupt_rows(spark, path, events.select("event_id", "value").schema).withColumn(
        "parquet", F.lit("accepted")
    )


@query(
    "preview",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, "
    "CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity / l_discount END AS ratio FROM lineitem "
    "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 100",
)
def _(spark, sf):
    # The ratio is infinite without a discount, so the preview has to blank it.
    lines = table(spark, sf, "lineitem").selectExpr(
        *LINE_KEY, "coalesce(try_divide(l_quantity, l_discount), DOUBLE('Infinity')) AS ratio"
    )
    return preview(lines, LINE_KEY)


@query("write_clean", "SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, c_acctbal FROM customer")
def _(spark, sf):
    out = table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_name", "nullif(c_mktsegment, 'BUILDING') AS c_mktsegment", "c_acctbal"
    )
    return read_csv(spark, write_clean(out, scratch_path(spark, "clean"), "customer.parquet"))


@query(
    "clean_preview",
    "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 50",
)
def _(spark, sf):
    return clean_preview(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_custkey"])


_KINDS = (
    "SELECT event_id, CAST(value AS VARCHAR) AS value_text, {ts} AS ts_text, event_type, props, "
    "CASE WHEN event_id < 0 THEN event_type END AS never FROM {events}"
)


@query(
    "infer_column_kinds",
    "WITH s AS (" + _KINDS.format(ts="CAST(ts AS VARCHAR)", events="events") + " ORDER BY event_id LIMIT 20), l AS ("
    + union_sql([f"SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM s"
                 for c in ("event_id", "value_text", "ts_text", "event_type", "props", "never")])
    + ") SELECT c AS \"column\", CASE WHEN count(v) = 0 THEN 'unknown' "
    "WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) FILTER (WHERE v IS NOT NULL) THEN 'numeric' "
    "WHEN bool_or(regexp_matches(v, '\\d{4}-\\d{2}-\\d{2}')) THEN 'datetime' ELSE 'categorical' END AS kind "
    "FROM l GROUP BY c",
)
def _(spark, sf):
    text = _KINDS.format(ts="CAST(ts AS STRING)", events="{events}").replace("VARCHAR", "STRING")
    return infer_column_kinds(spark.sql(text, events=table(spark, sf, "events")), ["event_id"])


# --- projections and filters -------------------------------------------------------


@query("select_numeric", f"SELECT {', '.join(LINE_NUMBERS)} FROM lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.select(*numeric_columns(df))


@query("select_categorical", "SELECT o_orderstatus, o_orderpriority FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders")
    return df.select(*categorical_columns(df))


_RATIO = "CASE WHEN l_discount = 0 THEN {inf} WHEN l_tax = 0 THEN {nan} ELSE l_tax / l_discount END"


@query(
    "finite_only",
    "SELECT l_orderkey, round(l_tax / l_discount, 6) AS ratio FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0",
)
def _(spark, sf):
    ratio = _RATIO.format(inf="DOUBLE('Infinity')", nan="DOUBLE('NaN')")
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey", f"{ratio} AS ratio")
    return rounded(finite_view(lines, ["ratio"], keep=["l_orderkey"]).where("ratio IS NOT NULL"))


@query(
    "null_safe_json",
    "SELECT l_orderkey, CASE WHEN l_discount <> 0 AND l_tax <> 0 THEN round(l_tax / l_discount, 6) END AS ratio FROM lineitem",
)
def _(spark, sf):
    ratio = _RATIO.format(inf="DOUBLE('-Infinity')", nan="DOUBLE('NaN')")
    return rounded(null_safe(table(spark, sf, "lineitem").selectExpr("l_orderkey", f"{ratio} AS ratio")))


@query(
    "drop_all_null_rows",
    f"SELECT l_discount, l_extendedprice, l_line FROM ({PLANTED_SQL}) p "
    "WHERE l_discount IS NOT NULL OR l_extendedprice IS NOT NULL OR l_line IS NOT NULL",
)
def _(spark, sf):
    lines = planted_lines(spark, sf).select("l_discount", "l_extendedprice", "l_line")
    return lines.dropna(how="all", subset=numeric_columns(lines))


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").drop("o_orderstatus", "o_orderpriority", "o_orderdate")


# --- schema, missing values, duplicates ---------------------------------------------


@query("table_shape", "SELECT count(*) AS n_rows, 11 AS n_cols FROM lineitem")
def _(spark, sf):
    return table_shape(table(spark, sf, "lineitem"))


@query(
    "logical_size",
    "SELECT CAST(b AS BIGINT) AS logical_bytes, round(b / (1024.0 * 1024.0), 6) AS logical_mb FROM ("
    "SELECT CAST(count(*) * 24 + sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority)) + count(*) * 8 AS DOUBLE) AS b "
    "FROM orders) t",
)
def _(spark, sf):
    return rounded(logical_size(table(spark, sf, "orders")))


@query(
    "column_types",
    "SELECT * FROM (VALUES ('event_id', 0, 'int64', 'integer'), ('ts', 1, 'datetime64[us]', 'datetime64'), "
    "('user_id', 2, 'int64', 'integer'), ('event_type', 3, 'object', 'string'), ('value', 4, 'float64', 'floating'), "
    "('props', 5, 'object', 'string')) t(\"column\", ordinal, dtype, inferred_type)",
)
def _(spark, sf):
    return column_types(table(spark, sf, "events"))


_PLANTED_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
                 "l_extendedprice", "l_returnflag", "l_linestatus", "l_line"]


@query(
    "null_counts",
    f"WITH p AS ({PLANTED_SQL}) SELECT * FROM ("
    + union_sql(
        [
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) * 100.0 / CAST(count(*) AS DOUBLE), 6) AS null_pct FROM p"
            for c in _PLANTED_COLS
        ]
    )
    + ") t WHERE null_count > 0",
)
def _(spark, sf):
    return rounded(null_counts(planted_lines(spark, sf)))


@query(
    "n_unique",
    f"WITH p AS ({PLANTED_SQL}) "
    + union_sql([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM p" for c in _PLANTED_COLS]),
)
def _(spark, sf):
    lines = planted_lines(spark, sf)
    return n_unique(lines, lines.columns)


@query(
    "first_unique_values",
    f"WITH p AS ({PLANTED_SQL}) "
    + union_sql(
        [
            f"SELECT '{c}' AS \"column\", CAST(rank AS INTEGER) AS rank, {shown} AS value FROM ("
            f"SELECT {c} AS v, row_number() OVER (ORDER BY min(row(l_orderkey, l_linenumber, l_partkey, l_suppkey))) AS rank "
            f"FROM p GROUP BY {c}) t WHERE rank <= 10"
            for c, shown in (("l_line", "CAST(v AS VARCHAR)"), ("l_partkey", "CAST(v AS VARCHAR)"),
                             ("l_quantity", "CAST(v AS VARCHAR)"), ("l_returnflag", "v"), ("l_linestatus", "v"))
        ]
    ),
)
def _(spark, sf):
    return first_values(
        planted_lines(spark, sf),
        ["l_line", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus"],
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    )


@query(
    "duplicate_rows",
    f"WITH p AS ({PLANTED_SQL}), u AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE l_quantity > 40) "
    "SELECT n - d AS duplicate_rows, round((n - d) * 100.0 / CAST(n AS DOUBLE), 6) AS duplicate_pct FROM ("
    "SELECT (SELECT count(*) FROM u) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM u) x) AS d) t",
)
def _(spark, sf):
    lines = planted_lines(spark, sf)
    return rounded(duplicate_rows(lines.unionByName(lines.where("l_quantity > 40"))))
