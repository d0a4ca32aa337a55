"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws `-ln(u) / weight` with u
hashed from the document id and the child's name; the smallest draw wins. A child is thus chosen in
proportion to its weight, and a change of one weight changes that child's draws only: rows move into
or out of the subtrees on the changed path and nowhere else.

A shard added by `grown` is a region of its own. All other draws stay, so it takes rows only
into itself, at every further step as well.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Levels of the tree below the root.
LEVELS = ("region", "rack", "shard")
#: Bits of a draw: all are exact in a double.
DRAW_BITS = 52
#: Rows that one task numbers at most on average, and the least number of groups of rows.
SLOT_ROWS, SLOT_GROUPS = 1_000_000, 64
#: Equal rows of one task are numbered as one while their positions agree but for so many low bits.
CHUNK_BITS = 16


@dataclass(frozen=True)
class Tree:
    """Children by path: `regions[region][rack] = {shard: weight}`. Weights are positive."""

    regions: dict[str, dict[str, dict[int, float]]] = field(default_factory=dict)

    def shards(self) -> list[int]:
        return [s for racks in self.regions.values() for shards in racks.values() for s in shards]

    def children(self) -> dict[str, list[tuple[str, float]]]:
        """By path, the children with the sums of the weights below; the root's path is empty."""
        out: dict[str, list[tuple[str, float]]] = {"": []}
        for region, racks in self.regions.items():
            out[region] = []
            for rack, shards in racks.items():
                path = f"{region}/{rack}"
                out[path] = [(f"{path}/{s}", float(w)) for s, w in shards.items() if w > 0]
                out[region].append((path, sum(w for _, w in out[path])))
            out[region] = [c for c in out[region] if c[1] > 0]
            out[""].append((region, sum(w for _, w in out[region])))
        out[""] = [c for c in out[""] if c[1] > 0]
        return out


def even_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> Tree:
    """Shards 0 to n - 1 of weight 1, filled rack by rack and region by region."""
    regions: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        rack = s // per_rack
        regions.setdefault(f"r{rack // racks_per_region}", {}).setdefault(f"k{rack}", {})[s] = 1.0
    return Tree(regions)


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    new = max(tree.shards(), default=-1) + 1
    return Tree({**tree.regions, f"g{new}": {f"g{new}": {new: weight}}})


def draw(key: Column, name: Column, weight: Column) -> Column:
    """An exponential draw whose rate is the weight; the same for a key and a name on every machine."""
    bits = F.shiftrightunsigned(F.xxhash64(key, name), 64 - DRAW_BITS)
    return -F.ln((bits.cast("double") + 0.5) / float(2**DRAW_BITS)) / weight


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key. A null key is placed like any other value."""
    children = tree.children()
    if not children[""]:
        raise ValueError("the tree has no shard of positive weight")
    table = F.create_map(
        *[
            x
            for path, nodes in children.items()
            for x in (
                F.lit(path),
                F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in nodes]),
            )
            if nodes
        ]
    )
    path = F.lit("")
    for _ in LEVELS:
        drawn = F.transform(
            F.element_at(table, path),
            lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name")),
        )
        path = F.array_min(drawn)["name"]
    return F.element_at(F.split(path, "/"), -1).cast("int")


def shard_slots(
    docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text", slot_rows: int = SLOT_ROWS
) -> DataFrame:
    """Per row: id, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot and grown_shard.

    `slot` numbers the rows of a shard without gaps: rows are numbered inside groups hashed by id, size and
    checksum, and a group begins where the groups before it end, so no task sees a whole shard. Rows equal in all
    of these are numbered as chunks, in runs of slots. A null text is empty. Rows that repeat an id share its shard
    and get slots of their own.
    """
    spark = docs.sparkSession
    key, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    groups = max(SLOT_GROUPS, math.ceil(docs.count() / slot_rows))
    rows = docs.select(
        key.alias(id_col),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place(key, tree).alias("shard"),
        place(key, grown(tree)).alias("grown_shard"),
        F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS).alias("chunk"),
    )
    group = F.pmod(F.xxhash64(id_col, "size", "text_crc32", F.lit("slot")), F.lit(groups))
    # Equal rows are interchangeable, so how they are cut into chunks does not show.
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows")).withColumn("slot_group", group)
    path = scratch_path(spark, "shards")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    before = (
        "sum(rows) OVER (PARTITION BY shard ORDER BY slot_group ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - rows"
    )
    starts = (
        rows.groupBy("shard", "slot_group")
        .agg(F.sum("rows").alias("rows"))
        .select("shard", "slot_group", F.expr(before).alias("first_slot"))
    )
    within = (
        f"sum(rows) OVER (PARTITION BY shard, slot_group ORDER BY `{id_col}`, size, text_crc32, chunk "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - rows"
    )
    numbered = rows.withColumn("within", F.expr(within)).join(starts, ["shard", "slot_group"])
    runs = numbered.withColumn("slot", F.col("first_slot") + F.col("within")).drop("first_slot", "within")
    # Dealt again, so that the chunks of equal rows become rows in many tasks.
    return runs.repartition("shard", "slot").select(
        id_col, "size", "text_crc32", "shard", F.explode(F.expr("sequence(slot, slot + rows - 1)")).alias("slot"), "grown_shard"
    )
