"""Signatures, bands and components against loops over all pairs of sets."""

import random

import numpy as np
import odd
import pytest

from frameglass.llm import minhash


def plain_set(text, k):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = (words + [word] if word else words), ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain(rows, k, percent):
    """(n, component) of each row, linked by all pairs."""
    sets = [plain_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), set()).add(doc)
    smallest = {r: min((d for d in docs if d is not None), default=None) for r, docs in least.items()}
    return [(len(s), smallest[find(i)] if s else rows[i][0]) for i, s in enumerate(sets)]


def altered(seed, centres, members, n_words, changes):
    """Texts of which each centre has altered copies that share too much for cheap proofs and too little for one star."""
    random.seed(seed)
    out = []
    for c in range(centres):
        words = [f"w{random.randrange(5000)}" for _ in range(n_words)]
        for _ in range(members):
            copy = list(words)
            for _ in range(random.randint(0, changes)):
                copy[random.randrange(n_words)] = f"n{random.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def check(spark, rows, k, percent, df=None):
    df = df or spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle=k, percent=percent).collect()]
    expected = [(d, n, c, d == c) for (d, _), (n, c) in zip(rows, plain(rows, k, percent))]
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_families_of_altered_copies(spark):
    texts = altered(1, 2, 30, 120, 9) + altered(2, 12, 3, 60, 3) + altered(3, 6, 2, 9, 1) + altered(4, 20, 1, 30, 0)
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    check(spark, rows, 3, 85)


def test_paths_and_other_parameters(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 80])) for i in range(30)]  # each links with its neighbours only
    check(spark, rows, 5, 80)


def test_odd_documents(spark):
    rows = [(r[0], r[1]) for r in odd.rows(2)]
    texts = {r[0]: r[1] for r in odd.rows(2)}
    df = odd.clashing(spark.createDataFrame(odd.rows(2), odd.DOCS).repartition(3))
    assert len(texts) == len(rows)
    check(spark, rows, 3, 85, df)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_repeats_and_null_ids(spark):
    rows = [(None, "a b c d"), (None, "A b c d"), (4, "x y"), (4, "x y"), (4, "other words here"), (9, "x y"), (None, "x y"), (2, None), (3, ""), (None, " ")]
    check(spark, rows, 3, 85)


@pytest.mark.parametrize("n", [1, 2, 5, 40, 199, 200, 3000])
def test_signature(n):
    """Full bins hold their least hash, empty ones that of a full one, and the share of equal bins follows the similarity."""
    rng = np.random.default_rng(n)
    s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    sig = minhash.signature(s)
    bins = [(int(h) >> 32) * minhash.BINS >> 32 for h in s]
    for b, h in zip(reversed(bins), reversed(s.tolist())):
        assert sig[b] <= h
    assert set(sig.tolist()) <= set(s.tolist())
    more = np.unique(np.append(s, rng.integers(0, 2**64, max(1, n // 10), dtype=np.uint64)))
    if n >= 40:
        assert abs((minhash.signature(more) == sig).mean() - len(s) / len(more)) < 0.12


def test_chance_to_share_no_bucket():
    """Pairs of the least similarity share a bucket but for the stated probability; small sets are no worse."""
    rng = np.random.default_rng(5)
    missed = 0
    for n in [6, 7, 12, 20, 60, 300] * 40:
        s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        extra = int(n / 0.85) - n
        t = np.unique(np.append(s, rng.integers(0, 2**64, extra, dtype=np.uint64)))
        missed += not set(minhash.band_keys(s)) & set(minhash.band_keys(t))
    assert missed == 0
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 2e-7


def test_members_that_nothing_in_their_bucket_can_be_like(spark):
    """Copies that hold too much of their own for any text of their size leave before they are compared, and only they."""
    rows = [(1, i, 100, 100 if i < 3 else 90, i) for i in range(40)]  # 90 shared shingles of 100 are enough for a smaller set only
    rows += [(2, 50, 100, 90, 50), (2, 51, 90, 90, 51), (3, 60, 100, 100, 60), (3, 61, 100, 100, 60)]
    df = spark.createDataFrame(rows, "key long, v long, n long, c long, root long")
    left = {(r.key, r.v) for r in minhash._likely(df, 85).collect()}
    assert left == {(1, 0), (1, 1), (1, 2), (2, 50), (2, 51)}
    rng = random.Random(7)
    rows = [(rng.randrange(12), i, n := rng.randrange(1, 60), n - rng.randrange(0, 1 + n // 4), rng.randrange(9)) for i in range(80)]
    df = spark.createDataFrame(rows, "key long, v long, n long, c long, root long")
    left = {r.v for r in minhash._likely(df, 85).collect()}
    for key, v, n, c, root in rows:
        for key2, v2, n2, c2, root2 in rows:
            if key == key2 and root != root2 and 100 * min(c, c2) >= 85 * (n + n2 - min(c, c2)):
                assert v in left and v2 in left


def family(seed, members, n_words, least, most, others):
    """Copies of one text with `least` to `most` words replaced by one of few others, so that what is not of the text repeats, too."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(n_words)]
    out = [" ".join(base)]
    for _ in range(members):
        copy = list(base)
        for at in rng.sample(range(n_words), rng.randint(least, most)):
            copy[at] = f"o{rng.randrange(others)}"
        out.append(" ".join(copy))
    return out


def test_rare_pairs(spark):
    """Whatever the rare shingles, each pair that is similar enough is given, or its frequent shingles suffice."""
    texts = family(3, 60, 40, 0, 4, 3) + altered(6, 3, 5, 40, 2)
    sets = [plain_set(t, 3) for t in texts]
    number = {w: i for i, w in enumerate(sorted(set().union(*sets)))}
    hashed = spark.createDataFrame([(v, [number[w] for w in s]) for v, s in enumerate(sets)], "v long, hashes array<long>")
    rows = [(k, v, len(s), v // 4, len(s)) for v, s in enumerate(sets) for k in (0, 1)]
    members = spark.createDataFrame(rows, "key long, v long, n long, root long, c long")
    pairs, left = minhash._rare_pairs(members, hashed, 85)
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(set(got)) == len(got)
    times = {w: sum(w in s for s in sets) for w in number}
    frequent = [{w for w in s if times[w] > minhash.RARE} for s in sets]
    assert sorted((r.key, r.v, r.c) for r in left.collect()) == sorted((k, v, len(f)) for v, f in enumerate(frequent) for k in (0, 1))
    for b, t in enumerate(sets):
        for a, s in enumerate(sets[:b]):
            if a // 4 != b // 4 and 100 * len(s & t) >= 85 * len(s | t):
                assert (a, b) in got or 185 * min(len(frequent[a]), len(frequent[b])) >= 85 * (len(s) + len(t))
    assert all(a // 4 != b // 4 and (sets[a] - frequent[a]) & (sets[b] - frequent[b]) for a, b in got)


def test_copies_too_unlike_for_a_link_are_not_all_compared(spark, monkeypatch):
    """In a family whose members mostly miss a link, compared pairs grow with the members and not with their square."""
    counts, kept = [], minhash.written

    def counted(df, label):
        out = kept(df, label)
        if label == "candidates":
            counts.append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", counted)
    rows = list(enumerate(family(8, 400, 150, 5, 6, 12)))
    check(spark, rows, 3, 85)
    assert 0 < sum(counts) < 16 * len(rows)
