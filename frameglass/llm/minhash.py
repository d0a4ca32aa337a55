"""Near-duplicate detection by one-permutation hashing, banded buckets and star-shaped candidate edges.

One hash of each shingle serves all bins: its leading bits choose the bin, and a bin keeps the least hash. An empty bin borrows
from a full one that it draws at random, the same way for all documents (optimal densification). Bands of bins are the buckets.

A bucket gives stars, not pairs: a hub is compared with the other members, and only with those of other components. A hub has
then done its work in that bucket and leaves it, and as long as members of several components are left, more of them
become hubs, sixteen times as many in each round. After the first round, members that have a rare shingle in common are compared by
an index of these, once; from then on only frequent shingles count as possibly shared, which members that are too unlike their
hub have too few of. So a bucket of copies costs one star, and every pair that shares a bucket is
connected, or compared, or cannot be similar enough because too few of its shingles are in any other member: documents
that share a passage but no more leave all buckets that way. Each compared pair is confirmed on its full sets of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import _written as written
from .components import components
from .texts import ascii_lower_bytes, byte_slices, utf8_values

SHINGLE, PERCENT, SEED = 5, 80, 42
#: A link of similarity 0.8 stays in no bucket with a probability of 1e-7, one of 0.85 of 1e-10.
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
_CHUNK = 1 << 18
#: Shingles of no more than so many members are rare.
RARE = 32
#: So many times as many hubs in each round.
GROWTH = 16
#: Row i: the order in which bin i asks the others for a value.
_DONORS = np.argsort(np.random.default_rng(SEED).random((BINS, BINS)), axis=1)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Ordered 64-bit hashes of the distinct shingles of a text; with fewer words the whole sequence is one."""
    words = ascii_lower_bytes(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends[shingle - 1 :].tolist() or [len(joined)]
    parts = [
        np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])], np.uint64))
        for at in range(0, len(ends), _CHUNK)
    ]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin, from ordered hashes; empty bins hold that of the first full bin in their order."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    full = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    out, has = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[full]], has[bins[full]] = hashes[full], True
    empty = np.flatnonzero(~has)
    donors = _DONORS[empty]
    out[empty] = out[donors[np.arange(len(empty)), has[donors].argmax(1)]]
    return out


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band, of all bands apart."""
    data, width = signature(hashes).tobytes(), 8 * ROWS
    return [xxhash.xxh64_intdigest(data[i * width : (i + 1) * width], i) - (1 << 63) for i in range(BANDS)]


def _fingerprinted(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc, place, node, n, bands): the digest of each row's set, its size and band keys; no words, no node. `place` tells the
    texts of an id apart."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for start, stop in byte_slices(texts):
            for text in utf8_values(texts.slice(start, stop - start)):
                s = shingle_set(text, shingle)
                out.append({"node": xxhash.xxh3_128_digest(s.tobytes()), "n": len(s), "bands": band_keys(s)} if len(s) else {"node": None, "n": 0, "bands": None})
        return pa.array(out, pa.struct({"node": pa.binary(), "n": pa.int64(), "bands": pa.list_(pa.int64())}))

    found = F.arrow_udf(run, "struct<node: binary, n: long, bands: array<long>>")(F.col("text"))
    return docs.select("doc", "place", found.alias("f")).select("doc", "place", "f.*")


def _sets(docs: DataFrame, places: DataFrame, shingle: int) -> DataFrame:
    """(v, hashes): the full sets of the nodes v, read again from one text of each."""

    def run(texts: pa.Array) -> pa.Array:
        parts = [shingle_set(t, shingle).view(np.int64) for a, b in byte_slices(texts) for t in utf8_values(texts.slice(a, b - a))]
        return pa.array(parts, pa.list_(pa.int64()))

    at = places.select(F.col("doc").alias("at_doc"), F.col("place").alias("at_place"), "v")
    one = docs.join(at, docs["doc"].eqNullSafe(F.col("at_doc")) & (docs["place"] == F.col("at_place")))
    one = one.dropDuplicates(["v"]).select("v", "text")  # of rows that repeat id and text
    return one.select("v", F.arrow_udf(run, "array<long>")("text").alias("hashes"))


def _hashes(members: DataFrame, sets: DataFrame) -> DataFrame:
    return sets.join(members.select("v").distinct(), "v", "left_semi").select("v", F.explode("hashes").alias("hash"))


def _shared(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members (key, v, n, root) with `c`, how many of their shingles any other member of any bucket has; those go that share
    too few of them for a link with whatever other member."""
    hashes = _hashes(members, sets)
    alone = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("times"), F.min("v").alias("v")).filter("times = 1")
    alone = alone.groupBy("v").agg(F.count(F.lit(1)).alias("u"))
    counted = members.join(alone, "v", "left").select("key", "v", "n", "root", (F.col("n") - F.coalesce("u", F.lit(0))).alias("c"))
    return counted.filter(f"100 * c >= {percent} * n")


def _rare_pairs(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of different components that have a rare shingle in common, one of no more than RARE members, and may be similar
    enough; and the members with `c` of frequent shingles only.

    Two sets meet in no more than the rare shingles that both have and the lesser of both counts of frequent ones. So once these
    pairs are compared, the frequent ones alone must be enough for any other link. A rare shingle is in fewer than RARE pairs with a
    member, so the pairs grow with the members.
    """
    hashes = _hashes(members, sets)
    rare = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") <= RARE)
    rare = written(hashes.join(rare, "hash").select("hash", "v", "times"), "rare-shingles")
    own = rare.groupBy("v").agg(F.count(F.lit(1)).alias("u"))
    nodes = members.select("v", "n", "root").distinct().join(own, "v", "left")
    nodes = written(nodes.select("v", "n", "root", (F.col("n") - F.coalesce("u", F.lit(0))).alias("c")), "frequent-shingles")
    both = rare.filter("times > 1").select("hash", "v")
    met = both.withColumnRenamed("v", "a").join(both.withColumnRenamed("v", "b"), "hash").filter("a < b")
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"))
    for end in "ab":
        met = met.join(nodes.select(F.col("v").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "root", "c")]), end)
    possible = f"root_a <> root_b AND {100 + percent} * (met + least(c_a, c_b)) >= {percent} * (n_a + n_b)"
    return met.filter(possible).select("a", "b"), members.drop("c").join(nodes.select("v", "c"), "v")


def _rooted(members: DataFrame, stars: DataFrame) -> DataFrame:
    """The members with the `root` that the stars give them now."""
    columns = [c for c in members.columns if c != "root"]
    return members.join(stars.select("node", F.col("root").alias("up")), members["v"] == F.col("node"), "left").select(*columns, F.coalesce("up", "v").alias("root"))


def _open(members: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, by `root`."""
    several = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    return members.join(several, "key", "left_semi")


def _likely(members: DataFrame, percent: int) -> DataFrame:
    """The same for members with `c`, less those that no member of their bucket can be like.

    Two sets meet in no more than the lesser of both c, so a link needs (100 + percent) times each c to be at least percent times the sum
    of both sizes: its own c beside the least size of the bucket, and its own size beside the most that any c leaves for it.
    """
    spare = F.expr(f"{100 + percent} * c - {percent} * n")
    reach = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least_n"), F.max(spare).alias("most"))
    possible = f"{100 + percent} * c >= {percent} * (n + least_n) AND most >= {percent} * n"
    return _open(members.join(reach.filter("low < high"), "key").filter(possible).select(*members.columns))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked for."""
    a, b = (sets.select(F.col("v").alias(c), F.col("hashes").alias(f"set_{c}")) for c in "ab")
    both = pairs.join(b, "b").join(a, "a").withColumn("met", F.size(F.array_intersect("set_a", "set_b")))
    return both.filter(f"100 * met >= {percent} * (size(set_a) + size(set_b) - met)").select("a", "b")


def star_links(docs: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """(node, root) of all nodes v that links connect to a smaller one, None without any; the head of this file has the rounds."""
    members = written(_open(nodes.select("v", "n", F.explode("bands").alias("key"), F.col("v").alias("root"))), "buckets")
    sets = written(_sets(docs, nodes.join(members.select("v").distinct(), "v").select("v", "doc", "place"), shingle), "sets")
    members, stars, hubs = _shared(members, sets, percent), None, 1
    while True:
        rest = written(_likely(members, percent), "open-buckets")
        if rest.isEmpty():
            return stars
        rare = None
        if hubs == GROWTH:  # copies of the first hubs are gone, so this is done for few members
            rare, rest = _rare_pairs(rest, sets, percent)
            rest = written(_likely(rest, percent), "frequent-buckets")
        # Those go first that have least of their own, as an original has among its altered copies. Each task passes on no
        # more than so many members of a bucket.
        at = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.col("c") / F.col("n")), "v")).alias("at")
        chosen = written(rest.select("*", at).filter(F.col("at") <= hubs), "hubs")
        hub = chosen.select("key", F.col("v").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "c", "root")])
        # No more shingles can meet than the lesser of both shares with others.
        possible = f"root <> root_a AND 100 * least(c, c_a) >= {percent} * (n + n_a - least(c, c_a))"
        pairs = rest.join(hub, "key").filter(possible).select(F.least("a", "v").alias("a"), F.greatest("a", "v").alias("b"))
        pairs = written((pairs if rare is None else pairs.union(rare)).distinct(), "candidates")
        found = written(_confirmed(pairs, sets, percent), "links")
        members = rest.join(chosen.select("key", "v"), ["key", "v"], "left_anti")
        if not found.isEmpty():
            stars = components(found if stars is None else found.union(stars.select("node", "root")))
            members = _rooted(members, stars)
        hubs *= GROWTH


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per document: its id, n_shingles (size of its set), component_id (smallest id that links reach) and kept.

    Sets of distinct shingles link when 100 times their intersection is at least `percent` times their union. A
    document without words, or with a null text, has an empty set and is linked with nothing, not even its like. Rows that repeat an id
    are one document each with its own text. Null ids count only where a component has no other, whose component_id is null; such
    rows are all kept. An empty table gives none.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), text.alias("text"), F.xxhash64(text).alias("place"))
    printed = written(_fingerprinted(rows, shingle), "signatures")
    nodes = (
        printed.filter("node IS NOT NULL").groupBy("node", "n", "bands")
        .agg(F.min("doc").alias("first"), F.min(F.struct("doc", "place")).alias("at"))
        .select("node", "n", "bands", "first", "at.doc", "at.place", F.monotonically_increasing_id().alias("v"))
    )
    nodes = written(nodes, "distinct-sets")  # written, so that numbers stay
    stars = star_links(rows, nodes, shingle, percent)
    rooted = nodes.select("node", "first", F.col("v").alias("root"))
    if stars is not None:
        up = stars.select(F.col("node").alias("v"), "root")
        rooted = nodes.join(up, "v", "left").select("node", "first", F.coalesce("root", "v").alias("root"))
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    named = rooted.join(least, "root").select("node", "component_id")
    linked = printed.filter("node IS NOT NULL").join(named, "node").select("doc", "n", "component_id")
    single = printed.filter("node IS NULL").select("doc", "n", F.col("doc").alias("component_id"))
    return linked.union(single).select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept")
    )
