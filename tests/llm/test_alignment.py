"""Aligned tokens against loops over bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import odd
import pytest
from tokenizers import Tokenizer

from frameglass.llm import alignment
from frameglass.llm import queries as Q
from frameglass.llm.tokens import packed

A, B = Q.tokenizer("byte_bpe_50k.json"), Q.tokenizer("piece_bpe_32k.model")
ZERO = (0, 0, 0, 0, 0, 0, "")


def plain_groups(text):
    """Lists of ids of both sides for each group; none if a side does not spell the text."""
    import sentencepiece

    if not text:
        return []
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    side_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids_a]
    side_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in ids_b for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    if b"".join(x for _, x in side_a) != whole or b"".join(x for _, x in side_b) != whole:
        return []
    ends = []
    for side in (side_a, side_b):
        at, out = 0, []
        for _, x in side:
            at += len(x)
            out.append(at)
        ends.append(out)
    groups, start = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        groups.append([[i for (i, _), e in zip(side, out) if start < e <= cut] for side, out in zip((side_a, side_b), ends)])
        start = cut
    return groups


def plain(texts):
    """Measures of each text."""
    all_groups = [plain_groups(t) for t in texts]
    links = [[(x, y) for a, b in groups for x in a for y in b] for groups in all_groups]
    held = Counter(p for found in links for p in set(found))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for groups, found in zip(all_groups, links):
        if not groups:
            out.append(ZERO)
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(found), sum(held[p] == best[p[0]] for p in found),
            sum(held[p] for p in found), hashlib.sha256(text.encode()).hexdigest(),
        ))
    return out


TEXTS = [*odd.TEXTS[:14], odd.sentence(2, 60), "a▁b", "<s> </s> <0x41> <|endoftext|>", "😀東京 x" * 9, "=" * 300 + "-" * 77, "\u0000 \n\n\n  ﬁ", "zzz퟿"]


def measures(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("at_once", [1 << 21, 3])
def test_against_plain_loops(spark, monkeypatch, at_once):
    monkeypatch.setattr(alignment, "_AT_ONCE", at_once)
    texts = TEXTS + TEXTS[8:16] + [TEXTS[14]] * 5
    tool = alignment.aligner(A, B)
    s = tool.align([(t or "").encode() for t in texts])
    expected = plain(texts)
    assert [tuple(x) for x in zip(s.n_a.tolist(), s.n_b.tolist(), s.n_groups.tolist(), s.n_links.tolist())] == [e[:4] for e in expected]
    assert [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in tool.group_texts(s)] == [e[6] for e in expected]
    if at_once > 3:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
        assert measures(alignment.alignments(odd.clashing(df), A, B)) == sorted((i, *e) for i, e in enumerate(expected))


def test_small_chunks_repeats_and_nulls(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None), (3, ""), (4, odd.sentence(4, 300)), (5, "a▁b"), (None, odd.sentence(9, 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    expected = sorted(((-1 if i is None else i), *e) for (i, t), e in zip(rows, plain([t for _, t in rows])))
    assert measures(alignment.alignments(df, A, B)) == expected
    assert alignment.alignments(df.limit(0), A, B).count() == 0


def test_group_lists(spark):
    texts = [t for t in TEXTS if t]
    rows = alignment.group_lists(spark.createDataFrame([(t,) for t in texts], "text string"), A, B).collect()
    for r in rows:
        groups, i, j = [], 0, 0
        for n, m in zip(r.in_a, r.in_b):
            groups.append([r.a[i : i + n], r.b[j : j + m]])
            i, j = i + n, j + m
        assert groups == plain_groups(r.text)


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    """White space of all kinds around the cuts, and a memory that forgets."""
    tool = alignment.Aligner(A, B)
    tool.recent.limit = 5
    texts = [a + b + c for a in ("", "x", "x ", "!", "1\n") for b in (" ", "  ", " \n ", "\t ", " \u3000 ", " \x1c", "\x85 ", "\u00a0 ") for c in ("", "y", " y", "\ny", "'s")]
    for part in (texts[:70], texts[70:], texts):
        whole = [packed(e.ids) for e in tool.a.encode_batch_fast([f" {t}" for t in part], add_special_tokens=False)]
        assert tool._side_a(part) == whole


def test_pieces_of_both_sides_give_whole_texts(monkeypatch):
    """Side b sees the pieces of side a: what it cannot spell leaves the rest of a slice alone, and a known piece costs no call."""
    tool = alignment.Aligner(A, B)
    texts = ["a  b c", " lead", "x ▁ y z", "w ▁", "tail ", "a \n b  ", "東京 é x", "c c c x y", "", "a  b c", "a\n b \nc\n\nd", "\t", " "]
    s = tool.align([t.encode() for t in texts])
    starts = [0, *s.n_b.cumsum().tolist()]
    spelled = [tool.b.encode(t) if "▁" not in t else [] for t in texts]
    assert [s.b[i:j].tolist() for i, j in zip(starts, starts[1:])] == spelled
    assert [n > 0 for n in s.n_a.tolist()] == [bool(ids) for ids in spelled]

    class Silent:
        def encode(self, pieces, **_):
            assert not pieces
            return []

    monkeypatch.setattr(tool, "b", Silent())
    again = tool.align([b"a  b c", b"c c x y c"])
    assert again.n_b.tolist() == [s.n_b[0], s.n_b[7]] and tool.group_texts(again)[0] == tool.group_texts(s)[0]


@pytest.mark.parametrize("high", [9, 1 << 30])
def test_sums_of_pairs(high):
    rng = np.random.default_rng(4)
    text, a, b, n = (rng.integers(0, m, 400) for m in (5, 3, 4, 9))
    a[a == 2] = high
    got = alignment._summed(text << 20 if high > 9 else text, a << 32 | b, n)
    expected = Counter()
    for t, x, y, k in zip(text.tolist(), a.tolist(), b.tolist(), n.tolist()):
        expected[t << 20 if high > 9 else t, x << 32 | y] += k
    assert list(zip(*(g.tolist() for g in got))) == [(*key, expected[key]) for key in sorted(expected)]


def test_pieces_met_before_are_not_asked_again(monkeypatch):
    """Some 170,000 words are remembered, with the same ids when they are looked up in an older generation."""
    tool = alignment.Aligner(A, B)
    texts = [" ".join(f"{c}{i}" for i in range(85_000)).encode() for c in "xy"]
    slices = [tool.align([t, b"one  two \xe2\x96\x81"]) for t in texts]
    asked = []

    class Counting:
        def encode(self, pieces, **kwargs):
            asked.extend(pieces)
            return [[] for _ in pieces]

    monkeypatch.setattr(tool, "b", Counting())
    for t, s in zip(texts, slices):
        again = tool.align([t])
        assert (again.a.tolist(), again.b.tolist()) == (s.a.tolist(), s.b.tolist()) and s.n_b[1] == 0
    assert asked == []


def test_pieces_take_over_what_is_met_again():
    """Places stay those of their ids through generations and after the last pieces are forgotten."""
    known, rng = alignment.Pieces(50), random.Random(2)
    of = lambda p: np.arange(int(p), int(p) + int(p) % 4, dtype=alignment.ID)
    computed = 0
    for _ in range(60):
        pieces = {str(rng.randrange(300) if rng.random() < 0.3 else rng.randrange(20)) for _ in range(12)}
        new = sorted(known.missing(pieces), key=lambda p: int(p) > 280)
        computed += len(new)
        known.add(new, [(np.concatenate([of("0"), *map(of, new)]), np.array([int(p) % 4 for p in new], np.int64))] * 2)
        some = sorted(pieces)
        for side in known.sides:
            ids, counts = side.take(np.array([known.now[p] for p in some]))
            assert ids.tolist() == [i for p in some for i in of(p).tolist()] and counts.tolist() == [int(p) % 4 for p in some]
        known.forget([p for p in new if int(p) > 280])
    assert 0 < computed < 60 * 6
