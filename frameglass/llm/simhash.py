"""Near-duplicate detection by SimHash, with candidates found by pigeonring filtering.

Of a 64-bit fingerprint, d + 1 segments stand in a ring. If two fingerprints differ in at most d bits, there is
a segment from which on every chain of l segments differs in at most l * d / (d + 1) bits, rounded down: the
first segment is equal, the first two differ in at most one bit, the first three in two, and so on. So each
fingerprint is filed under its first two segments for every start in the ring, and looked up under these and all that
differ in one bit of the second. Pairs that meet are pruned by the longer chains before all bits are compared.

Fingerprints of one bucket are linked, and the links of a batch are reduced to a spanning forest where they are
found, so a group of many copies gives as many links as it has members. Buckets of more than `SMALL_BUCKET`
fingerprints use no ring: the bits that may still differ are cut into d + 1 parts, of which one must be equal
(plain pigeonhole, without chains or budgets), again and again, and what is linked already is not compared again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .components import _written as written
from .texts import ascii_lower_bytes, byte_slices, utf8_values

SHINGLE, SEED, DISTANCE = 4, 42, 4
BITS = 64
#: Fingerprints of a bucket that are compared one by one at most.
SMALL_BUCKET = 256
_CHUNK = 1 << 18


# -- fingerprints -----------------------------------------------------------------------------------
def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text: a bit is 1 if it is in over half the hashes of its shingles."""
    words = ascii_lower_bytes(text).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[shingle - 1 :].tolist() or [len(joined)]
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(ends), _CHUNK):  # memory does not follow the length of a text
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprints of a text column as signed 64-bit integers; a null text has fingerprint zero."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [fingerprint(t, shingle) for a, b in byte_slices(texts) for t in utf8_values(texts.slice(a, b - a))]
        return pa.array(np.array(rows, np.uint64).view(np.int64), pa.int64())

    return F.arrow_udf(run, "long")(text)


# -- the ring ---------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Ring:
    """Segments of nearly equal width, and what chains of them may differ in."""

    distance: int

    @property
    def segments(self) -> int:
        return self.distance + 1

    def spans(self) -> list[tuple[int, int]]:
        """First bit and width of each segment."""
        cuts = [round(i * BITS / self.segments) for i in range(self.segments + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:])]

    def mask(self, start: int, length: int) -> int:
        spans = self.spans()
        return sum((1 << w) - 1 << at for at, w in (spans[(start + k) % self.segments] for k in range(length)))

    def budget(self, length: int) -> int:
        return length * self.distance // self.segments


def filed(values: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints: a row for each start under the own key (even), and one for each key looked up (odd)."""
    spans, keys, out = ring.spans(), [], []
    for i, (at, width) in enumerate(spans):
        after, next_width = spans[(i + 1) % ring.segments]
        first = (values >> np.uint64(at)) & np.uint64((1 << width) - 1)
        second = (values >> np.uint64(after)) & np.uint64((1 << next_width) - 1)
        head = first << np.uint64(next_width)
        for flip in [0, *(1 << b for b in range(next_width))]:
            keys.append((head | second ^ np.uint64(flip)) << np.uint64(4) | np.uint64(i << 1 | (flip > 0)))
            out.append(values)
    return np.concatenate(keys), np.concatenate(out)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with a link less than members: every node's link to the least one of its component."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def near(values: np.ndarray, distance: int, free: int = (1 << BITS) - 1, small: int = SMALL_BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints that agree on all bits outside `free`, as a spanning forest."""
    n = len(values)
    parent = np.arange(n)

    def roots(members: np.ndarray) -> np.ndarray:
        up = parent[members]
        while (parent[up] != up).any():
            up = parent[up]
        parent[members] = up
        return up

    def join(members: np.ndarray) -> None:
        up = roots(members)
        parent[up] = parent[members] = up.min()

    def work(members: np.ndarray, bits: list[int]) -> None:
        up = roots(members)
        if (up == up[0]).all():
            return
        if len(bits) <= distance:
            join(members)
        elif len(members) <= small:
            v = values[members]
            close = np.bitwise_count(v[:, None] ^ v[None, :]) <= distance
            left = np.ones(len(members), bool)
            while left.any():
                seen = np.zeros(len(members), bool)
                seen[np.argmax(left)] = True
                front = seen
                while front.any():
                    front = close[front].any(0) & ~seen
                    seen |= front
                join(members[seen])
                left &= ~seen
        else:
            for part in np.array_split(np.array(bits), distance + 1):
                mask = np.uint64(sum(1 << int(b) for b in part))
                key = values[members] & mask
                order = np.argsort(key, kind="stable")
                rest = [b for b in bits if b not in set(part.tolist())]
                for group in np.split(members[order], np.flatnonzero(np.diff(key[order])) + 1):
                    if len(group) > 1:
                        work(group, rest)

    work(np.arange(n), [b for b in range(BITS) if free >> b & 1])
    label = roots(np.arange(n))
    linked = label != np.arange(n)
    return values[linked], values[label[linked]]


def bucket_links(keys: np.ndarray, values: np.ndarray, ring: Ring, small: int = SMALL_BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of whole buckets, sorted by key: own rows come first in each."""
    bucket = keys >> np.uint64(1)
    # The bucket of a key looked up is that of the own key: the low bit alone tells them apart.
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    has_own = keys[starts] & np.uint64(1) == 0
    a, b = [], []
    for s, n in zip(starts[has_own & (sizes > small)].tolist(), sizes[has_own & (sizes > small)].tolist()):
        start = int(bucket[s]) & 7
        x, y = near(np.unique(values[s : s + n]), ring.distance, ((1 << BITS) - 1) & ~ring.mask(start, 1), small)
        a.append(x)
        b.append(y)
    usual = has_own & (sizes > 1) & (sizes <= small)
    place = np.arange(len(keys)) - np.repeat(starts, sizes)
    rows = np.flatnonzero(np.repeat(usual, sizes))
    lag = 1
    while len(rows := rows[place[rows] >= lag]):
        other = rows - lag
        own = keys[other] & np.uint64(1) == 0
        i, j = rows[own], other[own]
        differ = values[i] ^ values[j]
        start = (bucket[i] & np.uint64(7)).astype(np.int64)
        for length in range(3, ring.segments + 1):
            masks = np.array([ring.mask(k, length) for k in range(ring.segments)], np.uint64)
            ok = np.bitwise_count(differ & masks[start]) <= ring.budget(length)
            i, j, differ, start = i[ok], j[ok], differ[ok], start[ok]
        ok = (np.bitwise_count(differ) <= ring.distance) & (differ != 0)
        a.append(values[i[ok]])
        b.append(values[j[ok]])
        lag += 1
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(a), np.concatenate(b))


def links(distinct: DataFrame, distance: int = DISTANCE, small: int = SMALL_BUCKET) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp` that connect all that differ in at most `distance` bits."""
    if not 1 <= distance <= 7:
        raise ValueError("the distance is from 1 to 7 bits")
    ring = Ring(distance)

    def file(batches):
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(values), 4096):
                keys, out = filed(values[at : at + 4096], ring)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(out.view(np.int64))], names=["key", "fp"])

    def link(batches):
        held_keys, held = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((held_keys, batch.column(0).to_numpy().view(np.uint64)))
            values = np.concatenate((held, batch.column(1).to_numpy().view(np.uint64)))
            bucket = keys >> np.uint64(1)
            whole = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            if whole:
                yield batch_of(*bucket_links(keys[:whole], values[:whole], ring, small))
            held_keys, held = keys[whole:], values[whole:]
        if len(held):
            yield batch_of(*bucket_links(held_keys, held, ring, small))

    def batch_of(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    rows = distinct.select("fp").mapInArrow(file, "key long, fp long")
    placed = rows.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return placed.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per document: its id, fingerprint (16 hexadecimal digits) and component_id.

    Fingerprints link when they differ in at most `distance` bits; component_id is the smallest id that links
    reach. A null text has no words, as an empty one; all such documents share fingerprint zero. Rows
    that repeat an id are one document. Null ids count only where a component has no other. An empty table gives
    none.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), fingerprints(F.col(f"`{text_col}`"), shingle).alias("fp"))
    rows = written(rows, "fingerprints")
    rooted = _rooted(rows.groupBy("fp").agg(F.min("doc").alias("first")), distance)
    # Written, so that the join reads two plain shuffles and a component of very many fingerprints is split.
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _rooted(distinct: DataFrame, distance: int) -> DataFrame:
    """The distinct fingerprints `fp` with `first`, and the `root` of their component."""
    stars = components(links(distinct, distance))
    return distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component: the one with the smallest id, null ids last, and of its texts the one of the least digest.

    Rows are told apart by id and text, so an id with two texts is two documents, and rows that repeat both leave one.
    """
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    digest = F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))
    rows = written(docs.select(doc.alias("doc"), digest.alias("digest"), fingerprints(text, shingle).alias("fp")), "fingerprints")
    # Ordered as (is null, id, digest, rows that repeat both); repeats are counted before anything is moved.
    counted = rows.groupBy("fp", "doc", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "digest", "n")).alias("first")
    rooted = _rooted(written(counted.groupBy("fp").agg(first), "first-rows"), distance)
    first = F.min("first").alias("first")
    least = written(rooted.groupBy("root").agg(first).select(
        F.col("first.doc").alias("__fg_doc"), F.col("first.digest").alias("__fg_digest"), F.col("first.n").alias("__fg_rows")), "kept-rows")
    same = doc.eqNullSafe(F.col("__fg_doc")) & (digest == F.col("__fg_digest"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(least.filter("__fg_rows = 1"), same, "left_semi")
    repeated = least.filter("__fg_rows > 1")
    if repeated.isEmpty():
        return kept
    one = docs.join(repeated, same).dropDuplicates(["__fg_doc", "__fg_digest"])
    return kept.unionByName(one.select(*names))
