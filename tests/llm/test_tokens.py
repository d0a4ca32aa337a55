"""Token stores and packing against the library and against the definition of a packing."""

import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import odd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frameglass.llm import packing, token_store
from frameglass.llm.tokens import Encoder

WORD = str(public_tokenizers.path("word_bpe_49k.json"))
BYTE = str(public_tokenizers.path("byte_bpe_50k.json"))


def library(texts, path=WORD):
    tok = Tokenizer.from_file(path)
    return [np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_ids_of_whole_texts(path):
    texts = [t or "" for t in odd.TEXTS] + [odd.sentence(i, 50) for i in range(200)]
    spaces = [f"a'{c}s{c}{c}B́{c}." for c in map(chr, [*range(33), 0x85, 0xA0, 0x1680, 0x2000, 0x2028, 0x200B, 0x3000])]
    spaces += [f"Ab{c}{c}1 {c}.{c}" for c in map(chr, range(256))] + ["a , b.,c ...d 12 3x (x) <x> O'x", "ÀÉß×÷"]
    latin = [chr(c) for c in range(0xC0, 0x180)]
    spaces += [f"A{a}{b} x{b}1{a}, {a}́ {a}.{b}" for a, b in zip(latin, latin[1:])]
    enc = Encoder(path, cached=4_000)
    assert enc.by_piece == (path == WORD)
    for t, ids in zip(texts + spaces, library(texts + spaces, path)):
        assert enc.encode([t.encode()])[0] == ids.tobytes(), t


def expected_store(rows, end):
    out, start = [], 0
    for r, ids in zip(rows, library([r[1] for r in rows])):
        whole = [*ids, end]
        out.append((r[0], start, len(whole), zlib.crc32(np.array(whole, "<u4").tobytes())))
        start += len(whole)
    return out


def test_store_reads_back_what_the_library_gives(spark, tmp_path):
    path = str(tmp_path / "t")
    token_store.write_tokens(odd.clashing(odd.docs(spark, 4)), path, WORD, 1)
    got = token_store.stored_digests(spark, path).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected_store(odd.rows(4), 1)
    assert token_store.read_tokens(spark, path, 9, 30).count() == 8


def test_start_is_where_the_ids_lie(spark, tmp_path, monkeypatch):
    """Repeated and null ids with different texts: the ids at `start` of the joined files are those of the row."""
    monkeypatch.setattr(token_store, "RUN_ROWS", 3)
    texts = ["a b c d e", "one", "four words are here", "x y"] * 6
    rows = [(None if i % 5 == 0 else 1 if i % 3 else i, t + " z" * (i % 7)) for i, t in enumerate(texts)]
    path = str(tmp_path / "store")
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, WORD, 1)
    stored = spark.read.parquet(path).select(token_store.file_number().alias("f"), "_metadata.row_index", "doc_id", "tokens")
    joined = [x for r in sorted(stored.collect(), key=lambda r: (r.f, r.row_index)) for x in r.tokens]
    got = token_store.stored_digests(spark, path).collect()
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        assert zlib.crc32(np.array(joined[r.start : at], "<u4").tobytes()) == r.ids_crc32
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_store_layout(spark, tmp_path):
    path = tmp_path / "t"
    docs = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"))
    token_store.write_tokens(docs, str(path), WORD, 1, page_rows=500)
    file = pq.ParquetFile(next(path.glob("part-*")))
    columns = {c.path_in_schema: c for c in (file.metadata.row_group(0).column(i) for i in range(3))}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    ids = columns["tokens.list.element"]
    assert any("DICTIONARY" in e for e in ids.encodings) and ids.has_offset_index and ids.has_column_index


def test_store_of_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    token_store.write_tokens(odd.docs(spark).limit(0), path, WORD, 1)
    assert token_store.stored_digests(spark, path).count() == 0


def check_packing(rows, pieces, capacity=4096):
    ids = {r[0]: np.append(x, 2).astype("<u4") for r, x in zip(rows, library([r[1] for r in rows]))}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[doc])
            assert p.ids_crc32 == zlib.crc32(ids[doc][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[doc])
    padding = 0
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, sum(len(x) for x in ids.values())


def test_packing(spark):
    pieces = packing.pack(odd.clashing(odd.docs(spark, 5)), WORD, 2, with_ids=True).collect()
    assert all(zlib.crc32(bytes(p["ids"])) == p.ids_crc32 for p in pieces)
    padding, total = check_packing(odd.rows(5), pieces)
    assert padding <= 0.01 * total
    assert packing.pack(odd.docs(spark).limit(0), WORD, 2).count() == 0


def test_packing_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    padding, total = check_packing(rows, packing.pack(docs, WORD, 2, pool_ids=20_000).collect())
    assert padding <= 0.01 * total


@pytest.mark.parametrize("counts, space", [({5: 2, 3: 4, 9: 1}, 14), ({7: 3, 4: 1}, 13), ({2: 5}, 1), ({1: 3, 6: 2}, 16), ({}, 5)])
def test_fill_is_the_best_multiset(counts, space):
    items = [n for n, c in counts.items() for _ in range(c)]
    sums = {sum(s) for k in range(len(items) + 1) for s in combinations_with_replacement(items, k) if not Counter(s) - Counter(items)}
    best, used = packing.fill(counts, space)
    assert best == max(s for s in sums if s <= space)
    assert sum(n * c for n, c in used.items()) == best and all(c <= counts[n] for n, c in used.items())
