"""Quality rules with evidence of the host.

Each document is measured once. Base rules reject it alone. A soft rule has two limits: beyond the hard one a
document is rejected wherever it comes from, between the two the host decides. For that, failures
of the soft limit are counted per host and rule, and those of the base rules as one rule more. The rates are shrunk to
a beta prior fitted to all hosts by moments, and a host whose rate is high with near certainty, by its posterior, has a bad standing
for this rule, so hosts with few documents are not judged by them alone. A bad standing in a soft rule rejects documents that
fail this rule, one in the base rules those that fail any soft rule. Documents without a soft failure are never
rejected for their host.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .texts import byte_slices, utf8_values

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no character
CAPITALS, SMALL = bytes(range(65, 91)), bytes(range(97, 123))
WINDOW = 8

#: Base rules: fewest words, and the largest share of words in repeated windows in per cent.
MIN_WORDS, REPEAT_PERCENT = 20, 30
#: A host's standing is bad if its rate is more than this many times the rate of all hosts with 99 % of the posterior,
#: taken as normal: so many standard deviations lie between its mean and this bound.
BAD_LIFT, CREDIBLE = 2.0, 2.326
BASE_RULE = "base"
PRIOR_STRENGTH = (1.0, 1e6)


@dataclass(frozen=True)
class SoftRule:
    """A share of two measures, in SQL; beyond `soft` the host decides, beyond `hard` the document goes."""

    name: str
    part: str
    whole: str
    soft: float
    hard: float


SOFT_RULES = (
    SoftRule("symbols", "n_symbols", "n_words", 0.1, 0.4),
    SoftRule("capitals", "n_capitals", "n_capitals + n_small", 0.3, 0.6),
    SoftRule("dup_lines", "n_dup_lines", "n_lines", 0.3, 0.6),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_small")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of `size` words which occurs twice or more.

    Windows with equal hashes are compared word by word; windows with different hashes are different.
    """
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = h[:n].copy()
    for k in range(1, size):
        w = w * _ODD + h[k : k + n]
    order = np.argsort(w, kind="stable")
    same = np.flatnonzero(w[order][1:] == w[order][:-1])
    if not len(same):
        return 0
    seen: dict[tuple, int] = {}
    covered = np.zeros(len(words) + 1, np.int64)
    for i in np.unique(np.concatenate((order[same], order[same + 1]))).tolist():
        window = tuple(words[i : i + size])
        first = seen.setdefault(window, i)
        if first != i:
            for at in ((first, i) if first >= 0 else (i,)):
                covered[at] += 1
                covered[at + size] -= 1
            seen[window] = -1
    return int(np.count_nonzero(np.cumsum(covered)))


def measure(text: bytes) -> tuple[int, ...]:
    """The measures of a text given in UTF-8, in the order of `MEASURES`."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    continued = len(text) - len(text.translate(None, CONTINUATION))
    return (
        len(words), sum(map(len, words)) - continued, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(text) - len(text.translate(None, CAPITALS)), len(text) - len(text.translate(None, SMALL)),
    )


def measures(text: Column) -> Column:
    """A struct of the measures of a text column; a null text has no words."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [measure(t) for a, b in byte_slices(texts) for t in utf8_values(texts.slice(a, b - a))]
        columns = zip(*rows) if rows else [[] for _ in MEASURES]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))

    return F.arrow_udf(run, "struct<" + ", ".join(f"{m}: long" for m in MEASURES) + ">")(text)


M, HOST, SOFT, HARD, BASE = "__fg_measures", "__fg_host", "__fg_soft", "__fg_hard", "__fg_base_failed"


def _measured(docs: DataFrame, text_col: str, host_col: str, rules) -> DataFrame:
    """`docs` with the measures, the base verdict, failed soft rules and whether a hard limit is passed."""
    names = re.compile(rf"\b({'|'.join(MEASURES)})\b")

    def value(r: SoftRule) -> str:
        return names.sub(rf"{M}.\1", f"coalesce(try_divide({r.part}, {r.whole}), 0)")

    soft = F.expr("array_compact(array(" + ", ".join(f"IF({value(r)} > {r.soft}, '{r.name}', NULL)" for r in rules) + "))")
    hard = F.expr(" OR ".join(f"{value(r)} > {r.hard}" for r in rules) or "false")
    base = F.expr(f"{M}.n_words < {MIN_WORDS} OR 100 * {M}.n_repeat_words > {REPEAT_PERCENT} * {M}.n_words")
    return (
        docs.withColumns({M: measures(F.col(f"`{text_col}`")), HOST: F.col(f"`{host_col}`").cast("string")})
        .withColumn(BASE, base)
        .withColumn(SOFT, soft)
        .withColumn(HARD, hard)
    )


def host_rates(measured: DataFrame, rules=SOFT_RULES) -> DataFrame:
    """Per host and rule, the base rules as one: documents, failures, rate, shrunk rate, and whether the standing is bad.

    A host is a name; null is one more. Counts are summed in each task before they are moved.
    """
    counts = measured.groupBy(HOST).agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(BASE).alias(BASE_RULE),
        *[F.count_if(F.array_contains(SOFT, r.name)).alias(r.name) for r in rules],
    )
    names = [BASE_RULE, *[r.name for r in rules]]
    long = counts.select(
        F.col(HOST).alias("host"), "docs",
        F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("failed")) for n in names])).alias("x"),
    ).select("host", "docs", "x.*")
    fitted = long.groupBy("rule").agg(
        F.sum("docs").alias("n"), F.sum("failed").alias("f"), F.count(F.lit(1)).alias("hosts"),
        F.sum(F.expr("double(failed) * failed / docs")).alias("squares"),
    )
    # Variance between hosts: what is left of the variance of their rates beyond that of drawing documents.
    prior = (
        fitted.withColumn("mean", F.expr("f / n"))
        .withColumn("between", F.expr("squares / n - mean * mean - hosts * mean * (1 - mean) / n"))
        .withColumn("strength", F.expr(
            f"least({PRIOR_STRENGTH[1]}, greatest({PRIOR_STRENGTH[0]}, "
            f"IF(between > 0, mean * (1 - mean) / between - 1, {PRIOR_STRENGTH[1]})))"
        ))
        .select("rule", "mean", "strength")
    )
    shrunk = F.expr("(failed + mean * strength) / (docs + strength)")
    return (
        long.join(F.broadcast(prior), "rule")  # a row per rule
        .withColumns({"rate": F.expr("failed / docs"), "shrunk": shrunk})
        .withColumn("deviation", F.expr("sqrt(shrunk * (1 - shrunk) / (docs + strength + 1))"))
        .withColumn("bad", F.expr(f"shrunk - {CREDIBLE} * deviation > {BAD_LIFT} * mean"))
        .select("host", "rule", "docs", "failed", "rate", "shrunk", "bad")
    )


def judged(docs: DataFrame, text_col: str = "text", host_col: str = "source", rules=SOFT_RULES, with_text: bool = True) -> DataFrame:
    """`docs` with `__fg_measures`, `__fg_base_failed` and `__fg_kept`.

    The measured rows are written once below the checkpoint folder. Only documents between a soft and a hard
    limit meet the table of hosts; the join splits a host that has many of them. A null text has no words and
    is rejected. Without `with_text` the text is measured and left out.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "quality")
    rows = _measured(docs, text_col, host_col, rules)
    (rows if with_text else rows.drop(text_col)).write.parquet(path)
    rows = spark.read.parquet(path)
    standing = host_rates(rows, rules).filter("bad").withColumnRenamed("host", "__fg_bad_host")
    bad = standing.groupBy("__fg_bad_host").agg(F.collect_list("rule").alias("__fg_bad"))  # at most one more than soft rules
    undecided = F.expr(f"NOT {BASE} AND NOT {HARD} AND size({SOFT}) > 0")
    alone = rows.filter(~undecided)
    alone = alone.withColumn("__fg_kept", F.expr(f"NOT {BASE} AND NOT {HARD}"))
    unsure = rows.filter(undecided)
    failing = F.concat(F.col(SOFT), F.array(F.lit(BASE_RULE)))
    by_host = unsure.join(bad, F.col(HOST).eqNullSafe(F.col("__fg_bad_host")), "left").withColumn(
        "__fg_kept", ~F.coalesce(F.arrays_overlap(failing, "__fg_bad"), F.lit(False))
    )
    return alone.unionByName(by_host.drop("__fg_bad_host", "__fg_bad"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """One row per document: its id, the measures, base_failed and kept."""
    narrow = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((id_col, host_col))], F.col(f"`{text_col}`").alias("__fg_text"))
    out = judged(narrow, "__fg_text", host_col, with_text=False, **options)
    return out.select(
        F.col(f"`{id_col}`"), *[F.col(f"{M}.{m}") for m in MEASURES], F.col(BASE).alias("base_failed"), F.col("__fg_kept").alias("kept")
    )


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """The rows of `docs` that are kept, with the columns of `docs`."""
    rows = judged(docs, text_col, host_col, **options)
    return rows.filter("__fg_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
