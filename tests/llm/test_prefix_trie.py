"""The trie against plain dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from frameglass.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(sequences):
    """(conv, depth) -> the other columns, from {conv: [(role, text)]}."""
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved, out = {}, {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) if kids[n] else 1
        saved[n] = (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0) + sum(saved[k] for k in kids[n])
        ends = ",".join(map(str, sorted(c for c in members[n] if len(sequences[c]) == len(n))))
        up = min(members[n[:-1]]) if n else None
        out[min(members[n]), len(n)] = (up, len(members[n]), len(kids[n]), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest())
    return out


def plain_rebuilt(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def as_dict(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def rebuilt_trie(df):
    return as_dict(prefix_trie.trie(*prefix_trie.regrouped(prefix_trie.numbered(df))))


def some(seed, n, longest, choices):
    random.seed(seed)
    rows = []
    for c in range(n):
        for t in range(random.randint(1, longest)):
            rows.append((c, t, ["user", "assistant"][t % 2], f"text {random.randrange(choices)} é"))
    return rows


@pytest.mark.parametrize("seed, longest, choices", [(1, 6, 2), (2, 40, 1), (3, 13, 3)])
def test_rebuilt_conversations(spark, seed, longest, choices):
    rows = some(seed, 40, longest, choices)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rebuilt_trie(df) == plain_trie(plain_rebuilt(rows))


def test_odd_rows(spark):
    """Nulls, ties, gaps in ids, repeated rows, rows of no conversation, columns of other names."""
    rows = [(7, None, None, None), (7, 2, "user", ""), (7, 2, "user", "b"), (8, 0, "user", None), (8, 0, "user", None), (None, 1, "user", "lost"), (5, 3, "", "x" * 3000)]
    rows += [(10, t, "user", "same") for t in range(11)] + [(c, t, "user", "same") for c in (11, 12, 13, 14) for t in range(11)] + [(21, 0, None, "only")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("conv", "place", "x", "block", "turns", "depth", "n_convs")})
    assert rebuilt_trie(df) == plain_trie(plain_rebuilt(rows))
    assert rebuilt_trie(df.limit(0)) == {}
    turnless = {c: t for c, t in plain_rebuilt(rows).items() if not t}
    assert turnless  # conversation 21 has no turn left


def test_long_conversations_in_small_spans(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN", 3)
    monkeypatch.setattr(prefix_trie, "JOINED", 2)
    rows = [(c, t, "user", str(t if t < 50 + c % 3 else (t, c % 4))) for c in range(0, 60, 5) for t in range(70)]
    assert rebuilt_trie(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain_trie(plain_rebuilt(rows))


def test_only_roots(spark):
    convs = spark.createDataFrame([(4,), (2,)], "conv long")
    turns = spark.createDataFrame([], "conv long, place long, content binary, bytes long")
    assert as_dict(prefix_trie.trie(convs, turns)) == plain_trie({4: [], 2: []})
