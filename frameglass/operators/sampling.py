"""Repeatable row samples of an exact size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sql import quoted

SAMPLE_ROWS = 100_000
SEED = 42


def sample_key(key: Sequence[str], seed: int = SEED) -> Column:
    """A hex digest of the row key and the seed; its order is the sampling order."""
    text = ", ".join(f"CAST({quoted(c)} AS STRING)" for c in key)
    return F.expr(f"md5(concat_ws('|', '{seed}', {text}))")


def row_sample(
    df: DataFrame, key: Sequence[str], n: int = SAMPLE_ROWS, seed: int = SEED
) -> DataFrame:
    """All rows up to `n`, else the `n` rows with the smallest digest of their key.

    Digests are uniform, so a bound on them that keeps slightly more than `n` rows
    in all cuts the input before the sort: the final top-n sees about `n` rows, not
    `n` per task. `key` must identify a row.
    """
    total = df.count()
    if total <= n:
        return df
    keyed = df.withColumn("__digest", sample_key(key, seed))
    share = min(1.0, (n + 8 * math.sqrt(n) + 8) / total)
    while share < 1.0:
        bound = format(int(share * 16**12), "012x")
        near = keyed.where(F.col("__digest") < bound)
        if near.count() >= n:
            keyed = near
            break
        share = min(1.0, share * 2)
    return keyed.orderBy("__digest", *map(quoted, key)).limit(n).drop("__digest")
