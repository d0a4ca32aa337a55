"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Three combining steps, each of which groups by digest *and* full content, so equal digests of
different texts never merge:

1. equal texts of one task collapse before anything is moved (the partial aggregate),
2. what is left meets in salted digest groups, so a text that holds a third of all rows
   arrives at `salts` tasks,
3. the few winners of the salts meet by digest.

Then every row looks up its group by digest alone, and only rows whose digest stands for more than
one text (none, for SHA-256) are compared by content once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .texts import ascii_lower

DOC, BODY, DIGEST, SALT = "__fg_doc", "__fg_body", "__fg_digest", "__fg_salt"
KEEP, SIZE, TEXTS = "__fg_keep", "__fg_size", "__fg_texts"

#: Tasks among which one hot text is spread before its winners meet.
SALTS = 16


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def with_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """All rows and columns of `docs` with `__fg_keep` (id of the row that stays), `__fg_size`
    (rows of the group) and `__fg_digest`.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The largest
    id stays; a null id stands below all others. Rows that repeat id and text are one document: they
    share its verdict and count each for the size. An empty table gives an empty table. Only names
    that begin with `__fg_` are taken.
    """
    spark = docs.sparkSession
    body = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    texts = docs.select(F.col(f"`{id_col}`").alias(DOC), body.alias(BODY)).withColumn(DIGEST, digest(F.col(BODY)))
    salted = (
        texts.withColumn(SALT, F.pmod(F.xxhash64(DOC), F.lit(salts)))
        .groupBy(DIGEST, SALT, BODY)
        .agg(F.max(DOC).alias(KEEP), F.count(F.lit(1)).alias(SIZE))
    )
    combined = (
        salted.repartition(DIGEST).groupBy(DIGEST, BODY).agg(F.max(KEEP).alias(KEEP), F.sum(SIZE).alias(SIZE))
    )
    # Grouping by digest stays in the same partitions; the content is dropped unless digests collide.
    heads = combined.groupBy(DIGEST).agg(
        F.count(F.lit(1)).alias(TEXTS), F.max(KEEP).alias(KEEP), F.max(SIZE).alias(SIZE)
    )
    path = scratch_path(spark, "exact-heads")
    heads.write.parquet(path)
    heads = spark.read.parquet(path)
    rows = docs.withColumn(DIGEST, digest(body))
    single = rows.join(heads.filter(F.col(TEXTS) == 1).drop(TEXTS), DIGEST)
    collided = heads.filter(F.col(TEXTS) > 1).select(DIGEST)
    if collided.isEmpty():
        return single
    shared = rows.join(collided, DIGEST, "left_semi").withColumn(BODY, body)
    found = combined.join(collided, DIGEST, "left_semi")
    return single.unionByName(shared.join(found, [DIGEST, BODY]).drop(BODY))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept and the hex digest of the text."""
    doc = F.col(f"`{id_col}`")
    return with_groups(docs, id_col, text_col, **options).select(
        doc.alias(id_col),
        F.col(KEEP).alias("keep_id"),
        F.col(SIZE).alias("group_size"),
        doc.eqNullSafe(F.col(KEEP)).alias("kept"),
        F.lower(F.hex(DIGEST)).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of equal texts, with the columns of `docs`: one that has the id that stays.

    Only of groups of several rows, those that may repeat the id are reduced to one, by digest and full content.
    """
    kept = with_groups(docs, id_col, text_col, **options).filter(F.col(f"`{id_col}`").eqNullSafe(F.col(KEEP)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    several = kept.filter(F.col(SIZE) > 1).withColumn(BODY, ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    one = several.dropDuplicates([DIGEST, BODY])
    return kept.filter(F.col(SIZE) == 1).select(*names).unionByName(one.select(*names))
