"""The trie of conversation prefixes, grouped by blocks of turns first.

Conversations are cut into blocks of a fixed number of turns. A turn has a 128-bit hash of its place and content, and the hash of a
sequence is the exclusive or of its turns' hashes, so hashes of blocks add up to hashes of prefixes in any order and in parts.
Conversations are grouped by what precedes a block and by the block. Where all that share a prefix go on
with the same block, its turns are nodes with the members of the block, and nothing inside is hashed or grouped again. Only where
several blocks follow one prefix are the distinct blocks taken apart turn by turn.

Sums over subtrees need no walk: a node's smallest member is the smallest of the nodes below that only it leads to, so
what stands below a node is what its members lead to, less what its smallest member leads to above it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import _written as written

#: Turns of a block.
BLOCK = 4
#: Rows that are summed up in a row before their sums are; a conversation of any length is no single task's.
SPAN = 1024
#: Ids of members that end at a node are joined to texts of this many before a node's texts meet.
JOINED = 4096
_X = ("x", "y")


def _hashes(place: Column, content: Column) -> list[Column]:
    return [F.xxhash64(F.lit(salt), place, content).alias(x) for salt, x in enumerate(_X)]


def _running(rows: DataFrame, key: str, place: str, values: list[str], xor: bool) -> DataFrame:
    """`rows` with `before_*`: the values of all rows of the key at smaller places, put together. Places are distinct."""
    total = F.bit_xor if xor else F.sum

    def earlier(by: list[str], order: str, of: list[str]) -> list[Column]:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(total(v).over(w), F.lit(0)).alias(f"before_{v}") for v in of]

    spans = rows.withColumn("span", F.floor(F.col(place) / SPAN))
    sums = spans.groupBy(key, "span").agg(*[total(v).alias(f"sum_{v}") for v in values])
    starts = sums.select(F.col(key).alias("of_key"), F.col("span").alias("of_span"), *earlier([key], "span", [f"sum_{v}" for v in values]))
    inside = spans.select("*", *earlier([key, "span"], place, values))
    both = inside.join(starts, (F.col(key) == F.col("of_key")) & (F.col("span") == F.col("of_span")))
    put = (lambda a, b: a.bitwiseXOR(b)) if xor else (lambda a, b: a + b)
    return both.select(*[rows[c] for c in rows.columns], *[put(F.col(f"before_{v}"), F.col(f"before_sum_{v}")).alias(f"before_{v}") for v in values])


def numbered(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, content, bytes): turns in order from 0, null turns first, equal ones by their content; `content` is a digest of
    role and text, which are empty if null. Rows without a conversation's id belong to none.

    Turns are sorted over all tasks and counted in parts, so no conversation has to fit one task.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(
        F.col(f"`{id_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), content.alias("content"), F.octet_length(text).cast("long").alias("bytes")
    ).filter("conv IS NOT NULL")
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("content")]
    placed = rows.repartitionByRange(*order, F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    placed = written(placed, "turns")
    counts = placed.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    starts = counts.select("conv", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "content")) - 1
    inside = placed.withColumn("within", within)
    return inside.join(starts, ["conv", "part"]).select("conv", (F.col("start") + F.col("within")).alias("place"), "content", "bytes")


def regrouped(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv) and their turns, rebuilt: the first h turns of the first conversation of its group of ids, then the
    own turns but for the first h, where h comes from a hash of the id."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = turns.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), h.alias("h"))
    heads = turns.filter(F.col("place") < most - 1).withColumnRenamed("conv", "base")
    head = convs.join(heads, "base").filter("place < h").select("conv", "place", "content", "bytes")
    taken = turns.filter(F.col("place") < most - 1).groupBy(F.col("conv").alias("base")).agg(F.count(F.lit(1)).alias("has"))
    cut = convs.join(taken, "base", "left").select("conv", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("shift"))
    rest = turns.join(cut, "conv").filter("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("shift")).alias("place"), "content", "bytes")
    return convs.select("conv"), head.union(rest)


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv, block, x, y, turns, before_x, before_y): a row per block; `turns` has (place, x, y, bytes) in order."""
    hashed = turns.select("conv", "place", "bytes", *_hashes(F.col("place"), F.col("content")))
    rows = hashed.groupBy("conv", F.floor(F.col("place") / BLOCK).alias("block")).agg(
        *[F.bit_xor(x).alias(x) for x in _X], F.array_sort(F.collect_list(F.struct("place", *_X, "bytes"))).alias("turns")
    )
    return _running(rows, "conv", "block", list(_X), xor=True)


_BEFORE = ["before_x", "before_y"]


def _nodes(blocks: DataFrame, sums: list[Column], again: list[Column]) -> DataFrame:
    """A row per turn node: depth, its hash (x, y) and its parent's (up_x, up_y), conv, bytes and `sums` over its members.

    `sums` combine blocks to groups, `again` combines groups that share a node.
    """
    names = ["n_convs", *[f"s{i}" for i in range(len(again) - 1)]]
    groups = blocks.groupBy("block", *_BEFORE, *_X).agg(*[s.alias(n) for s, n in zip(sums, names)], F.min(F.struct("conv", "turns")).alias("least"))
    forks = groups.groupBy("block", *_BEFORE).agg(F.count(F.lit(1)).alias("ways"))
    marked = groups.join(forks, ["block", *_BEFORE])
    # Prefixes inside the block: the hash before it and that of the turns so far.
    upto = lambda x, less: F.aggregate(
        F.slice("least.turns", 1, F.col("at") + 1 - less), F.col(f"before_{x}"), lambda a, t: a.bitwiseXOR(t[x])
    )
    spread = marked.select("*", F.posexplode("least.turns").alias("at", "t"))
    turns = spread.select(
        "ways", (F.col("t.place") + 1).alias("depth"), *[upto(x, 0).alias(x) for x in _X], *[upto(x, 1).alias(f"up_{x}") for x in _X],
        F.col("least.conv").alias("conv"), F.col("t.bytes").alias("bytes"), *names,
    )
    key = ["depth", *_X, "up_x", "up_y"]
    alike = turns.filter("ways = 1").select(*key, "conv", "bytes", *names)
    refined = turns.filter("ways > 1").groupBy(*key).agg(
        F.min("conv").alias("conv"), F.max("bytes").alias("bytes"), *[s.alias(n) for s, n in zip(again, names)]
    )
    return alike.union(refined)


def _ends(ends: DataFrame) -> DataFrame:
    """From (depth, x, y, conv): the digest of the ascending, comma-joined ids of each node.

    Ids are sorted over all tasks and joined in runs, so only a few texts of a node meet in the task that must read them in order.
    """
    key = ["depth", *_X]
    kinds = f"depth long, x long, y long, first {ends.schema['conv'].dataType.simpleString()}"

    def join(batches):
        held, ids = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if ids and (row[:3] != held or len(ids) >= JOINED):
                    yield run_of(held, ids)
                    ids = []
                held = row[:3]
                ids.append(row[3])
        if ids:
            yield run_of(held, ids)

    def run_of(node, ids):
        return pa.RecordBatch.from_pylist([dict(zip(key, node), first=ids[0], ids=",".join(map(str, ids)))])

    def digest(batches):
        held, sha = None, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:3] == held:
                    sha.update(b",")
                else:
                    if held is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(key, held), ends_sha256=sha.hexdigest())])
                    held, sha = row[:3], hashlib.sha256()
                sha.update(row[4].encode())
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(key, held), ends_sha256=sha.hexdigest())])

    ranged = ends.select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv")
    runs = ranged.mapInArrow(join, f"{kinds}, ids string")
    return runs.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, "depth long, x long, y long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of conversations (conv) with turns (conv, place from 0, content, bytes), a row per node with a depth from 0, the root.

    conv_id is the smallest member, and with the depth names the node. n_leaves and saved_tokens are sums over the
    subtree; ends_sha256 digests the ids of members that end at the node. Without conversations there is no node, without turns
    the root alone. Sequences are told apart by 128 bits.
    """
    blocks = written(_blocks(turns), "blocks")
    nodes = written(_nodes(blocks, [F.count(F.lit(1))], [F.sum("n_convs")]), "trie-nodes")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).filter("conv IS NOT NULL")
    root = root.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), zero.alias("up_x"), zero.alias("up_y"), "conv", zero.alias("bytes"), "n_convs")
    nodes = nodes.union(root)
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    key = ["depth", *_X]
    nodes = nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", zero))
    own = [(F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")]
    nodes = written(nodes.select("*", *own), "trie-counts")
    # What each conversation leads to as the smallest member, in all and above a depth.
    led = nodes.groupBy("conv").agg(F.sum("leaf").alias("all_leaf"), F.sum("saved").alias("all_saved"))
    sums = [F.sum("all_leaf"), F.sum("all_saved")]
    below = _nodes(
        blocks.join(led, "conv", "left").na.fill(0, ["all_leaf", "all_saved"]), [F.count(F.lit(1)), *sums],
        [F.sum("n_convs"), F.sum("s0"), F.sum("s1")],
    ).select(*key, "s0", "s1")
    whole = led.agg(F.sum("all_leaf").alias("s0"), F.sum("all_saved").alias("s1")).filter("s0 IS NOT NULL")
    below = below.union(whole.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "s0", "s1"))
    above = _running(nodes.select("conv", *key, "leaf", "saved"), "conv", "depth", ["leaf", "saved"], xor=False)
    above = above.select(*key, "before_leaf", "before_saved")
    last = blocks.groupBy("conv").agg(F.max(F.struct("block", F.expr("element_at(turns, -1).place + 1 AS depth"), *[F.expr(f"before_{x} ^ {x} AS {x}") for x in _X])).alias("l"))
    ends = convs.join(last, "conv", "left").select(*[F.coalesce(f"l.{c}", zero).alias(c) for c in key], "conv")
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv").alias("parent_conv_id"))
    named = nodes.join(up, ["depth", "up_x", "up_y"], "left").join(below, key).join(above, key).join(_ends(ends), key, "left")
    return named.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", (F.col("s0") - F.col("before_leaf")).alias("n_leaves"),
        (F.col("s1") - F.col("before_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
