"""Sharding and exact deduplication against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import odd
import pytest
import xxhash
from pyspark.sql import functions as F

from frameglass.llm import exact_dedup, sharding


def plain_place(key: int, tree: sharding.Tree) -> int:
    children, path = tree.children(), ""
    first = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    for _ in sharding.LEVELS:
        draws = [(-math.log(((xxhash.xxh64_intdigest(n.encode(), first) >> 12) + 0.5) / 2**52) / w, n) for n, w in children[path]]
        path = min(draws)[1]
    return int(path.split("/")[-1])


def test_slots_and_places(spark):
    tree = sharding.even_tree(16)
    df = odd.clashing(odd.docs(spark, 10))
    got = sharding.shard_slots(df, tree, slot_rows=5).collect()
    texts = {r[0]: (r[1] or "").encode() for r in odd.rows(10)}
    assert len(got) == len(texts)
    slots = defaultdict(list)
    for r in got:
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        assert r.shard == plain_place(r.doc_id, tree) and r.grown_shard == plain_place(r.doc_id, sharding.grown(tree))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_growth_moves_rows_into_the_new_shard_only(spark):
    a = sharding.even_tree(16)
    b = sharding.grown(a)
    c = sharding.grown(b)
    p = spark.range(20_000).select(*[sharding.place(F.col("id"), t).alias(n) for n, t in (("a", a), ("b", b), ("c", c))]).toPandas()
    assert set(p.b[p.a != p.b]) == {16} and set(p.c[p.b != p.c]) == {17}
    assert abs((p.b == 16).mean() - 1 / 17) < 0.01 and p.a.value_counts().max() < 1.15 * 20_000 / 16


def test_weight_change_stays_in_its_subtrees(spark):
    a = sharding.even_tree(16)
    regions = {r: {k: dict(s) for k, s in racks.items()} for r, racks in a.regions.items()}
    regions["r1"]["k2"][9] = 3.0
    p = spark.range(20_000).select(sharding.place(F.col("id"), a).alias("a"), sharding.place(F.col("id"), sharding.Tree(regions)).alias("b")).toPandas()
    moved = p[p.a != p.b]
    assert len(moved) and (moved.b // 8 == 1).all() and abs((p.b == 9).mean() - 3 / 18) < 0.01
    assert (moved.b[moved.a // 8 == 1] // 4 == 2).all()
    with pytest.raises(ValueError):
        sharding.place(F.lit(1), sharding.Tree({}))


def test_shards_of_nothing_and_repeated_rows(spark):
    tree = sharding.even_tree(3)
    assert sharding.shard_slots(odd.docs(spark).limit(0), tree).count() == 0
    twice = sharding.shard_slots(odd.docs(spark).union(odd.docs(spark)), tree).collect()
    assert len(twice) == 2 * len(odd.TEXTS) == len({(r.shard, r.slot) for r in twice})


def plain_groups(rows):
    def norm(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    return {
        (i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids
    }


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda body: F.unhex(F.substring(F.sha2(body, 256), 1, 2))])
def test_exact_dedup(spark, digest):
    """The second digest has 256 values at most: equal digests of different texts stay apart."""
    rows = odd.rows(3) + [(10_000 + i, f"text {i % 300}", None, None, 0) for i in range(600)]
    df = odd.clashing(spark.createDataFrame(rows, odd.DOCS).repartition(5))
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.verdicts(df, digest=digest).collect()}
    assert got == {g[:4] for g in plain_groups(rows)}
    kept = exact_dedup.deduplicate(df, digest=digest)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({g[0] for g in got if g[3]})


def test_exact_dedup_edges(spark):
    assert exact_dedup.verdicts(odd.docs(spark).limit(0)).count() == 0
    got = exact_dedup.verdicts(spark.createDataFrame([(None, "a"), (1, "A"), (None, "b"), (2, "c"), (2, "c")], "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter(
        [(None, 1, 2, False), (1, 1, 2, True), (None, None, 1, True), (2, 2, 2, True), (2, 2, 2, True)]
    )


def test_rows_of_one_id_spread_over_slot_groups(spark, monkeypatch):
    """Neither rows of one id nor equal rows meet in one window, and slots stay without gaps."""
    written = []
    take = sharding.scratch_path
    monkeypatch.setattr(sharding, "scratch_path", lambda *a: written.append(take(*a)) or written[-1])
    monkeypatch.setattr(sharding, "CHUNK_BITS", 3)
    rows = [(None, f"text {i}") for i in range(300)] + [(7, "same")] * 300 + [(i, "x") for i in range(50)]
    got = sharding.shard_slots(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), sharding.even_tree(3)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(t) + 1) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    held = spark.read.parquet(written[0]).filter("doc_id IS NULL OR doc_id = 7").groupBy("shard", "slot_group").count()
    assert held.agg(F.max("count")).first()[0] < 90


def test_deduplicate_leaves_one_row_of_repeats_and_null_ids(spark):
    rows = [(None, "a"), (None, "A"), (2, "c"), (2, "c"), (2, "C"), (1, "c"), (2, "d"), (None, "e"), (None, None), (3, "")]
    for digest in (exact_dedup.sha256, lambda body: F.unhex(F.substring(F.sha2(body, 256), 1, 2))):
        kept = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), digest=digest).collect()
        assert Counter((r.doc_id, (r.text or "").lower()) for r in kept) == Counter([(None, "a"), (2, "c"), (2, "d"), (None, "e"), (3, "")])
