"""Token ids of a Hugging Face `tokenizers` file, with each distinct piece of text encoded once.

For tokenizers whose rules drop white space and never join across it, a text is cut at runs of ASCII white
space; its ids are those of its pieces, so a piece that a worker has met before is looked up and only
new ones go to the library. For the rules of one public tokenizer, texts of plain characters are cut into words
right away, which repeat more often, and new words go to the library's BPE model. Whole texts go to the
library for other tokenizers.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np

#: Bytes that a generation of a Python worker's memory takes; there are two, of words and of pieces. A worker that later stages
#: use keeps them, so they are small beside an executor.
CACHED_MEMORY = 24_000_000
#: Bytes that an entry takes beside its key and its ids, of which there are at most four bytes for each of the key.
ENTRY = 150
#: Longer pieces are encoded but not remembered.
CACHED_BYTES = 64

ID = np.dtype("<u4")


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def drops_white_space(rules: dict) -> bool:
    """Whether the file's splitting rule keeps only matches that hold no white space."""
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    return (
        first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
        and r"[^\s" in first.get("pattern", {}).get("Regex", "") and not any(
            t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in rules.get("added_tokens", [])
        )
    )


#: A splitting rule and normalisers for which texts of plain characters are cut into words by `_WORDS`.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Plain characters: printable ASCII without apostrophes and `<`, white space, and the letters of Latin-1.
_ASCII = bytes(b for b in [*range(9, 14), *range(32, 127)] if b not in b"'<")
_LATIN = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
_WORDS = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^a-z0-9\x80-\xff\t-\r ]+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level file: printable ones for themselves, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Recent:
    """What was met lately: when a generation is full, a new one begins and takes over what is met again."""

    def __init__(self, limit: int):
        self.limit, self.now, self.before = limit, {}, {}

    def missing(self, keys: set) -> set:
        """The keys that must be computed and put into `now`, which then holds all of `keys`."""
        if len(self.now) > self.limit:
            self.now, self.before = {}, self.now
        new = keys.difference(self.now)
        again = new & self.before.keys()
        self.now.update({k: self.before[k] for k in again})
        return new - again


class WordIds(dict):
    """The same for words that are computed one by one: a word that is not there is computed when it is asked for."""

    def __init__(self, limit: int, compute):
        super().__init__()
        self.limit, self.held, self.compute, self.before = limit, 0, compute, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.compute(word)
        if len(word) <= CACHED_BYTES:
            self[word] = ids
            self.held += len(word) + len(ids) + ENTRY
        return ids

    def turn(self) -> None:
        if self.held > self.limit:
            self.held, self.before = 0, dict(self)
            self.clear()


class Encoder:
    """Encodes texts given as UTF-8 bytes to little-endian 32-bit ids."""

    def __init__(self, path: str, cached: int = CACHED_MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_piece = drops_white_space(rules)
        normal = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        self.known = (
            self.by_piece and normal == KNOWN_NORMALIZERS and rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == KNOWN_SPLIT
        )
        self.letters = str.maketrans({chr(b): c for c, b in byte_letters().items()})
        self.tokenize = self.tokenizer.model.tokenize
        self.plain, self.pieces = WordIds(cached, self._model), Recent(cached // (5 * CACHED_BYTES + ENTRY))

    def _library(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [packed(e.ids) for e in found]

    def _words(self, text: bytes) -> list[bytes] | None:
        """The words of a text of plain characters, in small letters; None for other texts."""
        beyond = text.translate(None, _ASCII)
        if not _LATIN.fullmatch(beyond):
            return None
        return _WORDS.findall(text.decode().lower().encode() if beyond else text.lower())

    def _model(self, word: bytes) -> bytes:
        """Ids of a word by the library's BPE model."""
        return packed([t.id for t in self.tokenize(word.decode("latin-1").translate(self.letters))])

    def _by_pieces(self, texts: list[bytes]) -> list[bytes]:
        cut = [t.split() for t in texts]
        new = self.pieces.missing(set().union(*cut))
        known = self.pieces.now
        known.update(zip(new, self._library(list(new))))
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        for piece in [p for p in new if len(p) > CACHED_BYTES]:
            del known[piece]
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_piece:
            return self._library(texts)
        self.plain.turn()
        out: list[bytes | None] = []
        for text in texts:
            words = self._words(text) if self.known else None
            out.append(None if words is None else b"".join(map(self.plain.__getitem__, words)))
        rest = iter(self._by_pieces([t for t, ids in zip(texts, out) if ids is None]))
        return [next(rest) if ids is None else ids for ids in out]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
