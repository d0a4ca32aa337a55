"""The trie against the library."""

import hashlib
import random

import numpy as np
import odd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from frameglass.llm import bpe_trie

BYTE = str(public_tokenizers.path("byte_bpe_50k.json"))
SPACES = [f"a'{c}s{c}{c}B́{c}. {c}\t{c} x" for c in map(chr, [*range(33), 0x85, 0xA0, 0x1680, 0x2000, 0x2028, 0x200B, 0x3000, 0x1F600])]
MORE = ["<|endoftext|>a<|endoftext|><|endoftext|> b \n", "a" * 3000 + " " + "ab1'" * 2000, "word, word. word., don't. I'll, 'S", "…" * 700]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(BYTE)


def test_equals_the_library(tok):
    texts = [t or "" for t in odd.TEXTS] + SPACES + MORE + [odd.sentence(i, 60) for i in range(200)]
    random.seed(3)
    texts += ["".join(random.choices("aeiouthsn ,.'\n1é", k=60)) for _ in range(500)]
    for bpe in (bpe_trie.ByteBpe(BYTE), bpe_trie.ByteBpe(BYTE, cached=10, nodes=10)):
        for t in texts:
            ids = tok.encode(t, add_special_tokens=False).ids
            got = bpe.encode([t.encode()])[0]
            assert got == np.array(ids, "<u4").tobytes(), t[:60]
            assert bpe.decode(got).decode() == tok.decode(ids, skip_special_tokens=False)


def test_prefixes_are_computed_once():
    bpe = bpe_trie.ByteBpe(BYTE)
    bpe.encode([b"transformation transformations transform"])
    assert len(bpe.last) == 1 + len("transformation") + len(" transformations")


def test_fits_is_what_merging_says():
    bpe = bpe_trie.ByteBpe(BYTE)
    random.seed(4)
    ids = list(bpe.vocab.values())
    for a, b in zip(random.choices(ids, k=4000), random.choices(ids, k=4000)):
        if bpe.fits(-1, a):
            assert bpe.fits(a, b) == (bpe._merged(bpe.text_of[a] + bpe.text_of[b]) == [a, b])


def test_decoding_bytes_that_are_no_text(tok):
    bpe = bpe_trie.ByteBpe(BYTE)
    random.seed(6)
    for _ in range(200):
        ids = random.choices(range(50257), k=12)
        assert bpe.decode(np.array(ids, "<u4").tobytes()).decode() == tok.decode(ids, skip_special_tokens=False)


def test_round_trip_on_spark(spark, tok):
    got = {r.doc_id: r[1:] for r in bpe_trie.round_trip(odd.clashing(odd.docs(spark, 3)), BYTE).collect()}
    assert len(got) == 3 * len(odd.TEXTS)
    for i, t, *_ in odd.rows(3):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        data, text = np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe_trie.decode(bpe_trie.encode(odd.docs(spark), BYTE), BYTE)
    assert {r.doc_id: r.text for r in back.collect()} == {r[0]: r[1] or "" for r in odd.rows()}
    assert bpe_trie.round_trip(odd.docs(spark).limit(0), BYTE).count() == 0
