"""Byte-level BPE by a trie of distinct words, and its inverse.

The encoding of a prefix of a word ends in exactly one token, and only with that token do the encodings of
the prefixes of a word fit together: a token may follow another if merging the two byte strings
gives these two tokens again. So each trie node, which is a prefix, needs one state: its last token. A
depth-first walk derives a new node's state from the states on its path; prefixes that words share are
computed once, and a word's ids are read by jumping back from its node token by token.

A text is cut before runs of white space, where no rule of the splitting pattern reaches across; pieces
met before are looked up, new ones are split into words by the library's splitting step.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import byte_slices, utf8_values
from .tokens import ID, Recent, byte_letters, packed

#: Pieces in a generation of a Python worker's memory, and nodes at which its trie starts anew.
CACHED, NODES = 450_000, 1_000_000
#: Longer pieces are not remembered; longer words are encoded by the same steps without nodes.
LONG_PIECE, LONG_WORD = 64, 256

#: A full stop or comma after a letter begins a word of its own, and so may begin a piece.
_PIECE = re.compile(rb"[\t-\r ]*+[A-Za-z]++(?=[.,])|[\t-\r ]*+[^\t-\r ]+|[\t-\r ]+")
#: White space beyond ASCII: the library splits such texts as a whole.
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
ROOT = 0
NEVER = 1 << 60


class ByteBpe:
    def __init__(self, path: str, cached: int = CACHED, nodes: int = NODES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        splits = rules["pre_tokenizer"]
        if splits["type"] != "ByteLevel" or splits["add_prefix_space"] or not splits["use_regex"] or rules["normalizer"]:
            raise ValueError(f"{path} is not a byte-level BPE without normaliser")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        letters = byte_letters()
        self.unletter = str.maketrans({c: chr(b) for c, b in letters.items()})
        raw = {t.translate(self.unletter).encode("latin-1"): i for t, i in rules["model"]["vocab"].items()}
        self.vocab = raw
        self.longest = max(map(len, raw))
        self.reach: dict[bytes, int] = {}  # length of the longest token by its last two bytes
        for t in raw:
            self.reach[t[-2:]] = max(len(t), self.reach.get(t[-2:], 1))
        self.text_of = {i: t for t, i in raw.items()}
        self.merges = {}
        for rank, pair in enumerate(rules["model"]["merges"]):
            a, b = (x.translate(self.unletter).encode("latin-1") for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[raw[a], raw[b]] = (rank, raw[a + b])
        self.halves = {new: (*pair, rank) for pair, (rank, new) in self.merges.items()}
        if len(self.halves) != len(self.merges):
            raise ValueError(f"{path} makes a token by two merges")
        self.edges: tuple[dict, dict] = ({}, {})
        self.special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.text_of |= {i: t.encode() for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        flat = [self.text_of.get(i, b"") for i in range(max(self.text_of) + 1)]
        self.lengths = np.array([len(t) for t in flat])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(flat), np.uint8)
        self.recent, self.node_limit = Recent(cached), nodes
        self.fitting: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last: list[int] = [-1]
        self.back: list[int] = [ROOT]

    # -- one word ---------------------------------------------------------------------------------
    def _merged(self, data: bytes) -> list[int]:
        """Merging by rank, the leftmost first: the definition, for short strings."""
        ids = [self.vocab[bytes([x])] for x in data]
        while len(ids) > 1:
            rank, i = min((self.merges.get(p, (NEVER,))[0], i) for i, p in enumerate(zip(ids, ids[1:])))
            if rank == NEVER:
                break
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of a token while it is built, and the rank of the merge that takes each."""
        found = self.edges[side].get(token)
        if found is None:
            found, taken, t = [], NEVER, token
            while True:
                found.append((t, taken))
                if t not in self.halves:
                    break
                *both, taken = self.halves[t]
                t = both[side]
            self.edges[side][token] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a; a is -1 at the beginning of a word.

        It may not if a merge across the border comes while both its sides stand there: before the left one
        is taken, and not after the right one is, as of equal merges the leftmost is first.
        """
        found = self.fitting.get((a, b))
        if found is None:
            if a < 0:
                found = self._merged(self.text_of[b]) == [b]
            else:
                found = self.fits(-1, b) and not any(
                    self.merges.get((x, y), (NEVER,))[0] < min(x_taken, y_taken + 1, NEVER)
                    for x, x_taken in self._edge(a, 1)
                    for y, y_taken in self._edge(b, 0)
                )
            self.fitting[a, b] = found
        return found

    def _state(self, prefix: bytes, state_at) -> tuple[int, int]:
        """The last token of a prefix and where it begins, given the last tokens of shorter prefixes."""
        depth = len(prefix)
        for n in range(min(self.reach.get(prefix[-2:], 1), depth), 0, -1):
            token = self.vocab.get(prefix[depth - n :])
            if token is not None and self.fits(state_at(depth - n), token):
                return token, depth - n
        raise ValueError(f"no token ends {prefix!r}")

    # -- the trie ---------------------------------------------------------------------------------
    def _insert(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Add words, give every new node its state, and return the words' ids.

        Sorted words follow the trie depth first; the path to the word before is the stack.
        """
        child, last, back, found = self.child, self.last, self.back, {}
        path, held = [ROOT], b""
        for word in sorted(words):
            shared = len(os.path.commonprefix((held, word)))
            del path[shared + 1 :]
            for depth in range(shared, len(word)):
                key = path[depth] << 8 | word[depth]
                node = child.get(key)
                if node is None:
                    token, at = self._state(word[: depth + 1], lambda d: last[path[d]])
                    node = child[key] = len(last)
                    last.append(token)
                    back.append(path[at])
                path.append(node)
            held = word
            ids, node = [], path[-1]
            while node != ROOT:
                ids.append(last[node])
                node = back[node]
            found[word] = packed(ids[::-1])
        return found

    def _alone(self, word: bytes) -> bytes:
        """The same steps for one long word, with its states in a list."""
        states, begins = [-1], [0]
        for end in range(1, len(word) + 1):
            low = max(0, end - self.longest)
            token, at = self._state(word[low:end], lambda d, low=low: states[low + d])
            states.append(token)
            begins.append(low + at)
        ids, end = [], len(word)
        while end:
            ids.append(states[end])
            end = begins[end]
        return packed(ids[::-1])

    # -- texts ------------------------------------------------------------------------------------
    def _split(self, text: str) -> list[bytes]:
        return [w.translate(self.unletter).encode("latin-1") for w, _ in self.split(text)]

    def _parts(self, data: bytes) -> list[bytes | str]:
        """Pieces of a text; parts with white space beyond ASCII and special tokens come whole, as str."""
        out: list[bytes | str] = []
        for k, part in enumerate(self.cut.split(data.decode()) if self.cut else [data.decode()]):
            if k % 2 or _WIDE_SPACE.search(part):
                out.append(part)
            else:
                out.extend(_PIECE.findall(part.encode()))
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts as little-endian unsigned 32-bit integers."""
        cut = [self._parts(t) for t in texts]
        if len(self.last) > self.node_limit:
            self._clear()
        new, pieces = self.recent.missing(set().union(*cut)), self.recent.now
        special = {p for p in new if p in self.special}
        split = {p: self._split(p if isinstance(p, str) else p.decode()) for p in new - special}
        distinct = {w for ws in split.values() for w in ws}
        long = {w for w in distinct if len(w) > LONG_WORD}
        words = self._insert(distinct - long) | {w: self._alone(w) for w in long}
        pieces.update({p: b"".join([words[w] for w in ws]) for p, ws in split.items()})
        pieces.update({p: packed([self.special[p]]) for p in special})
        out = [b"".join(map(pieces.__getitem__, c)) for c in cut]
        for p in [p for p in split if len(p) > LONG_PIECE]:
            del pieces[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        tokens = np.frombuffer(ids, ID)
        lengths = self.lengths[tokens]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[tokens] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at].tobytes().decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for all tasks of a Python worker."""
    return ByteBpe(path)


def _mapped(docs: DataFrame, id_col: str, value_col: str, fields: str, make) -> DataFrame:
    """Rows of id and what `make` gives for slices of the value column."""

    def run(batches):
        for batch in batches:
            for start, stop in byte_slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                columns = make(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns.values()], names=["doc_id", *columns])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{value_col}`").alias("value"))
    return rows.mapInArrow(run, f"doc_id {kind}, {fields}")


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of every text, as little-endian unsigned 32-bit integers. A null text has none."""
    return _mapped(docs, id_col, text_col, "ids binary", lambda texts: {
        "ids": pa.array(byte_bpe(tokenizer).encode(utf8_values(texts)), pa.binary())
    })


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of every row of ids. Null ids give an empty text."""
    return _mapped(tokens, id_col, ids_col, "text string", lambda ids: {
        "text": pa.array([byte_bpe(tokenizer).decode(x or b"").decode() for x in ids.to_pylist()], pa.string())
    })


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the ids and of the text that they decode to.

    A null text is empty and has no ids. Repeated rows give repeated results, an empty table none.
    """

    def make(texts):
        bpe = byte_bpe(tokenizer)
        ids = bpe.encode(utf8_values(texts))
        return {
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
            "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
        }

    return _mapped(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
