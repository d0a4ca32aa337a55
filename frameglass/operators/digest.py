"""Digests, issue rules and score bands over tidy profile tables.

Every input carries a `table` column beside `column`, so that one query screens the
profiles of many tables at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tidy import union_all

# Thresholds of the digest, the issue rules and the colour bands.
ID_CARDINALITY = 1_000
WEAK_PAIR = 0.1
ISSUE_OUTLIER_PCT = 5.0
ISSUE_DUPLICATE_PCT = 1.0
NON_NEGATIVE_NAMES = r"(?i)(quantity|qty|price)"
DATASET = "__dataset__"
SHORT_TYPES = {"object": "str", "float64": "float", "int64": "int"}
NULL_RED_PCT = 10.0


def digest_columns(types: DataFrame, unique: DataFrame, missing: DataFrame) -> DataFrame:
    """(table, column, type, unique, null_pct); columns without nulls get 0."""
    short = F.coalesce(*[F.when(F.col("dtype") == k, v) for k, v in SHORT_TYPES.items()], F.col("dtype"))
    keys = ["table", "column"]
    return (
        types.join(unique, keys)
        .join(missing.select(*keys, "null_pct"), keys, "left")
        .select(
            *keys,
            short.alias("type"),
            F.col("n_unique").alias("unique"),
            F.coalesce("null_pct", F.lit(0.0)).alias("null_pct"),
        )
    )


def digest_numeric(numeric: DataFrame) -> DataFrame:
    """Numeric statistics without the quartiles; mean and std to 4 digits, skewness to 3."""
    return numeric.select(
        "table",
        "column",
        F.round("mean", 4).alias("mean"),
        "median",
        F.round("std", 4).alias("std"),
        "min",
        "max",
        F.round("skewness", 3).alias("skewness"),
        "zeros_pct",
        "outlier_pct",
    )


def digest_categorical(categorical: DataFrame, top: DataFrame) -> DataFrame:
    """(table, column, cardinality, mode, top_3, note); identifiers only get a note."""
    text = F.concat("value", F.lit(" ("), F.round("pct", 2).cast("string"), F.lit("%)"))
    # At most three rows per column are listed.
    listed = (
        top.where("rank <= 3")
        .groupBy("table", "column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("items"))
    )
    like_id = (F.col("cardinality") > ID_CARDINALITY) & (F.round("rare_pct", 2) == 100)
    return categorical.join(listed, ["table", "column"], "left").select(
        "table",
        "column",
        "cardinality",
        F.when(~like_id, F.col("mode")).alias("mode"),
        F.when(~like_id, F.array_join(F.col("items.t"), ", ")).alias("top_3"),
        F.when(like_id, "high-cardinality identifier").alias("note"),
    )


def digest_distributions(shapes: DataFrame, tests: DataFrame, outliers: DataFrame) -> DataFrame:
    keys = ["table", "column"]
    return shapes.join(tests, keys).join(outliers, keys).select(*keys, "shape", "is_normal", "outlier_pct")


def digest_correlations(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.abs(F.round("value", 4)) > WEAK_PAIR)


def digest_datetime(datetimes: DataFrame) -> DataFrame:
    """(table, column, field, value): one row per known field, the zone left out."""
    fields = ["min_date", "max_date", "date_range_days", "inferred_freq", "gaps_count", "seasonality_hint"]
    cells = [
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields
    ]
    return datetimes.select("table", "column", F.inline(F.array(*cells))).where("value IS NOT NULL")


def digest_quality(scores: DataFrame, flags: DataFrame) -> DataFrame:
    """(table, score, flags): flags of a table joined by `; `, at most one per column and kind."""
    listed = flags.groupBy("table").agg(
        F.array_join(F.array_sort(F.collect_list("flag")), "; ").alias("flags")
    )
    return scores.join(listed, "table", "left").select(
        "table", F.round("overall_score", 4).alias("score"), F.coalesce("flags", F.lit("")).alias("flags")
    )


def digest_overview(shape: DataFrame, sizes: DataFrame, duplicates: DataFrame, scores: DataFrame, types: DataFrame) -> DataFrame:
    """One row per table: rows, columns, size, duplicate share, score and column names."""
    names = types.groupBy("table").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "column"))).alias("c")
    )
    return (
        shape.join(sizes, "table")
        .join(duplicates, "table")
        .join(scores, "table")
        .join(names, "table")
        .select(
            "table",
            F.col("n_rows").alias("rows"),
            F.col("n_cols").alias("cols"),
            "logical_mb",
            "duplicate_pct",
            F.round("overall_score", 4).alias("quality_score"),
            F.array_join(F.col("c.column"), ", ").alias("column_names"),
        )
    )


def _issue(rows: DataFrame, column: Column, rule: str, value: Column) -> DataFrame:
    return rows.select(
        "table", column.alias("column"), F.lit(rule).alias("rule"), value.cast("double").alias("evidence")
    )


def issue_rules(missing: DataFrame, numeric: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(table, column, rule, evidence) for every statistic beyond its threshold."""
    name = F.col("column")
    return union_all(
        [
            _issue(missing.where("null_pct > 0"), name, "nulls", F.col("null_pct")),
            _issue(numeric.where(F.col("outlier_pct") > ISSUE_OUTLIER_PCT), name, "outliers", F.col("outlier_pct")),
            _issue(
                duplicates.where(F.col("duplicate_pct") > ISSUE_DUPLICATE_PCT),
                F.lit(DATASET), "duplicates", F.col("duplicate_pct"),
            ),
            _issue(
                numeric.where((F.col("min") < 0) & name.rlike(NON_NEGATIVE_NAMES)),
                name, "negative values", F.col("min"),
            ),
        ]
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 0.9, "good").when(score >= 0.7, "fair").otherwise("poor")


def strength_band(value: Column) -> Column:
    size = F.abs(value)
    return F.when(size > 0.7, "strong").when(size > 0.4, "moderate").when(size > 0.2, "weak").otherwise("none")


def null_band(pct: Column) -> Column:
    return F.when(pct > NULL_RED_PCT, "red").otherwise("amber")
