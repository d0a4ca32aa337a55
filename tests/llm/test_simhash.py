"""Fingerprints, links and components against plain loops over all pairs."""

import random
from functools import lru_cache

import numpy as np
import odd
import pytest
import xxhash
from pyspark.sql import functions as F

from frameglass.llm import simhash
from frameglass.llm.components import components


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = (words + [word] if word else words), ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, distance=4):
    """Smallest member reachable, by a search over all pairs."""
    v, out = np.array(values, np.uint64), {}
    left = set(range(len(v)))
    while left:
        front, seen = [min(left)], {min(left)}
        while front:
            i = front.pop()
            for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= distance).tolist():
                if j not in seen:
                    seen.add(j)
                    front.append(j)
        out |= {j: min(seen) for j in seen}
        left -= seen
    return [out[i] for i in range(len(v))]


@pytest.mark.parametrize("text", [*odd.TEXTS, odd.sentence(5, 3), odd.sentence(5, 4), "a b\nc\td E", "a a a a a a a a"])
def test_fingerprint(text, monkeypatch):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def cloud(seed: int, centres: int, members: int, flips: int, bits=range(64)):
    random.seed(seed)
    out = []
    for _ in range(centres):
        c = random.getrandbits(64)
        out += [c ^ sum(1 << b for b in random.sample(list(bits), random.randint(0, flips))) for _ in range(members)]
    return out


def as_components(values, a, b):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x, y in zip(a.tolist(), b.tolist()):
        parent[max(find(x), find(y))] = min(find(x), find(y))
    return {v: find(v) for v in values}


CLOUDS = [cloud(1, 150, 3, 6), cloud(2, 3, 120, 3), cloud(3, 1, 500, 12, range(20)), cloud(4, 15, 30, 9), cloud(5, 2, 250, 8, range(0, 64, 5))]


@lru_cache
def expected_of(k, distance):
    return plain_components(np.unique(np.array(CLOUDS[k], np.uint64)).tolist(), distance)


@pytest.mark.parametrize("k", range(len(CLOUDS)))
@pytest.mark.parametrize("distance", [1, 4, 7])
@pytest.mark.parametrize("small", [8, 256])
def test_no_link_is_lost(k, distance, small):
    v = np.unique(np.array(CLOUDS[k], np.uint64))
    ring = simhash.Ring(distance)
    keys, out = simhash.filed(v, ring)
    order = np.argsort(keys, kind="stable")
    a, b = simhash.bucket_links(keys[order], out[order], ring, small)
    assert len(a) <= 5 * (distance + 1) * 14 * len(v)
    expected = expected_of(k, distance)
    assert as_components(v.tolist(), a, b) == {x: int(v[i]) for x, i in zip(v.tolist(), expected)}
    x, y = simhash.near(v, distance, small=small)
    assert as_components(v.tolist(), x, y) == {z: int(v[i]) for z, i in zip(v.tolist(), expected)}


def test_ring_budgets():
    for d in range(1, 8):
        ring = simhash.Ring(d)
        assert sum(w for _, w in ring.spans()) == 64 and ring.mask(0, ring.segments) == 2**64 - 1
        assert [ring.budget(n) for n in range(1, ring.segments + 1)] == [*range(d), d]


def test_components_of_paths_and_hubs(spark):
    random.seed(7)
    path = [(i, i + 1) for i in range(400)]
    hub = [(10_000, 20_000 + i) for i in range(500)] + [(5, 5), (7, 6), (6, 7)]
    edges = path + hub
    random.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 401)}, **{20_000 + i: 10_000 for i in range(500)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    rows = odd.rows(3)
    random.seed(8)
    for k in range(60):
        words = odd.sentence(k, 80).split(" ")
        rows.append((1_000 + 10 * k, " ".join(words), None, None, 0))
        for m in range(k % 4):
            words[random.randrange(len(words))] = f"new{k}{m}"
            rows.append((1_000 + 10 * k + m + 1, " ".join(words), None, None, 0))
    df = odd.clashing(spark.createDataFrame(rows, odd.DOCS).repartition(5))
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [plain_fingerprint(r[1]) for r in rows]
    expected = plain_components(fps)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    smallest = {}
    for i in order:
        smallest.setdefault(expected[i], rows[i][0])
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {
        r[0]: (f"{fp:016x}", smallest[c]) for r, fp, c in zip(rows, fps, expected)
    }
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(smallest.values())


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    expected = [rows[i].doc_id for i in plain_components(fps)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {r.doc_id: (f"{fp:016x}", c) for r, fp, c in zip(rows, fps, expected)}
    hashed = docs.select(F.xxhash64(F.lit("a b c d")).alias("h")).first().h
    assert hashed % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_nothing_repeats_and_null_ids(spark):
    assert simhash.near_duplicates(odd.docs(spark).limit(0)).count() == 0
    rows = [(None, "a"), (4, "a"), (4, "a"), (None, "b")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def test_keep_one_leaves_one_row_of_each_component(spark):
    """Repeated rows, null ids, and an id with two texts of which one has a near copy."""
    near, far, other, alone = (" ".join(f"{w}{i}" for i in range(60)) for w in ("near", "far", "other", "alone"))
    rows = [(1, near), (2, near.upper()), (2, far), (3, other), (3, other), (None, other), (None, alone), (None, alone), (None, alone.upper())]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long").repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text.lower()) for r in kept.collect())) == sorted([(1, near), (2, far), (3, other), (0, alone)])
