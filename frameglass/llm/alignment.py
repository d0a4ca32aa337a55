"""Alignment of the tokens of two tokenizers, with each distinct text tokenised once.

Rows are shuffled by their full text and counted, so a text that a third of all rows repeat is one row with its
multiplicity before anything is tokenised. Each distinct text is cut into groups at the byte offsets where tokens of both
sides end; a token of one side links with all tokens of the other side in its group. How many documents
hold a pair of ids linked is summed over distinct texts, weighted by their multiplicity. Measures that need these counts
are looked up in chunks of texts, so a pair is moved once for a chunk instead of once for a text, and all measures are
joined to the rows at last.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import _written as written
from .texts import byte_slices, utf8_values
from .tokens import CACHED_BYTES, ID, byte_letters, packed

#: Texts of about this many bytes are a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 1_000_000
#: Neither side joins across a single space between words, so texts are cut there and a worker looks up what it met before.
_CUTS = re.compile(r"(?<=\S) (?=\S)")
#: A text without this is cut at all its spaces.
_RUNS = re.compile(r"\s | \s")
#: Such pieces that a worker remembers, twice; some 230 bytes each.
KNOWN_PIECES = 110_000
#: A pair of ids as one number.
_SHIFT = np.int64(32)
#: Pairs that are spread out at once.
_AT_ONCE = 1 << 21

_PAIRS = "pair_a array<int>, pair_b array<int>, pair_n array<long>"
_MEASURES = ("n_a", "n_b", "n_groups", "n_links")


class Slice:
    """The tokens of some texts, their groups, and the links, all as flat arrays in text order.

    `text_a`, `text_b` and `text_g` say which text a token or group is of, `group_a` and `group_b` which group a token is in,
    `in_a` and `in_b` how many tokens a group has. `links` has (text, pair, n): n links of a pair of ids in a text.
    """

    def __init__(self, side_a: tuple[np.ndarray, np.ndarray], side_b: tuple[np.ndarray, np.ndarray], len_a: np.ndarray, len_b: np.ndarray):
        """Of each side the ids of all texts and how many each text has."""
        (a, self.n_a), (b, self.n_b) = side_a, side_b
        self.n = n = len(self.n_a)
        self.a, self.b = a.astype(np.int64), b.astype(np.int64)
        self.text_a, self.text_b = np.repeat(np.arange(n), self.n_a), np.repeat(np.arange(n), self.n_b)
        # Both sides of a text have the same bytes, so offsets may run on from text to text.
        ends_a, ends_b = np.cumsum(len_a[self.a]), np.cumsum(len_b[self.b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        self.in_a = np.bincount(self.group_a, minlength=len(cuts))
        self.in_b = np.bincount(self.group_b, minlength=len(cuts))
        self.text_g = self.text_a[np.cumsum(self.in_a) - self.in_a]
        self.n_groups = np.bincount(self.text_g, minlength=n)
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, self.text_g, self.in_a * self.in_b)
        self.links = self._links()

    def _links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equal ids of a group are counted before they are paired, so a long group of few ids stays small."""
        ga, a, ca = _counted(self.group_a, self.a)
        gb, b, cb = _counted(self.group_b, self.b)
        many = np.bincount(gb, minlength=len(self.in_b))
        first = np.cumsum(many) - many
        spread = np.cumsum(many[ga])
        text, pair, count = [], [], []
        start = 0
        while start < len(ga):
            stop = max(start + 1, int(np.searchsorted(spread, (spread[start - 1] if start else 0) + _AT_ONCE, "right")))
            g, times = ga[start:stop], many[ga[start:stop]]
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[g], times)
            t, p, c = _summed(
                np.repeat(self.text_g[g], times), np.repeat(a[start:stop], times) << _SHIFT | b[place], np.repeat(ca[start:stop], times) * cb[place]
            )
            text.append(t)
            pair.append(p)
            count.append(c)
            start = stop
        if not text:
            return (np.zeros(0, np.int64),) * 3
        if len(text) == 1:
            return text[0], pair[0], count[0]
        return _summed(np.concatenate(text), np.concatenate(pair), np.concatenate(count))

    def in_groups(self) -> np.ndarray:
        """For each token of both sides, first all of a and then all of b, its place when groups are written one by one, a before b."""
        before_a, before_b = np.cumsum(self.in_a), np.cumsum(self.in_b)
        place_a = np.arange(len(self.a)) + (before_b - self.in_b)[self.group_a]
        place_b = np.arange(len(self.b)) + before_a[self.group_b]
        return np.concatenate((place_a, place_b))


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id), ordered, with their counts."""
    both, n = np.unique(group.astype(np.int64) << _SHIFT | ids, return_counts=True)
    return both >> _SHIFT, both & ((1 << 32) - 1), n


def _summed(text: np.ndarray, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, pair), ordered, with the sum of n."""
    if not len(text):
        return text, pair, n
    a, b = pair >> _SHIFT, pair & ((1 << 32) - 1)
    high_a, high_b = int(a.max()) + 1, int(b.max()) + 1
    # One number that has the order of both sorts several times as fast.
    small = (int(text.max()) + 1) * high_a * high_b < 1 << 63
    order = np.argsort((text * high_a + a) * high_b + b) if small else np.lexsort((pair, text))
    text, pair, n = text[order], pair[order], n[order]
    heads = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1]))))
    return text[heads], pair[heads], np.add.reduceat(n, heads)


def _lengths(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, parts), np.int64, len(parts))


class Ids:
    """Ids of many pieces, one after another; a piece is its place."""

    def __init__(self):
        self.ids, self.ends = np.zeros(0, ID), np.zeros(1, np.int64)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids = np.concatenate((self.ids, ids))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts)))

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at these places, and how many each has."""
        starts = self.ends[places]
        counts = self.ends[places + 1] - starts
        upto = np.cumsum(counts)
        return self.ids[np.arange(counts.sum()) + np.repeat(starts - upto + counts, counts)], counts

    def cut(self, n: int) -> None:
        self.ends = self.ends[: n + 1]
        self.ids = self.ids[: self.ends[-1]]


class Pieces:
    """Places and ids of both sides of pieces that were met lately. As in `Recent`, a new generation takes over what is met again."""

    def __init__(self, limit: int):
        self.limit, self.before = limit, ({}, (Ids(), Ids()))
        self.now, self.sides = {}, (Ids(), Ids())

    def missing(self, pieces: set[str]) -> set[str]:
        """The pieces that must be computed and added; `now` has the places of the others."""
        if len(self.now) > self.limit:
            self.before, self.now, self.sides = (self.now, self.sides), {}, (Ids(), Ids())
        places, sides = self.before
        new = pieces.difference(self.now)
        again = list(new & places.keys())
        at = np.fromiter(map(places.__getitem__, again), np.int64, len(again))
        self.add(again, [side.take(at) for side in sides])
        return new.difference(again)

    def add(self, pieces: list[str], sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.now.update(zip(pieces, range(len(self.now), len(self.now) + len(pieces))))
        for side, (ids, counts) in zip(self.sides, sides):
            side.add(ids, counts)

    def forget(self, last: list[str]) -> None:
        """Takes away the pieces that were added last."""
        for piece in last:
            del self.now[piece]
        for side in self.sides:
            side.cut(len(self.now))


def _joined(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(found), ID), _lengths(found) // ID.itemsize


class Aligner:
    """Side a: a byte-level file of the `tokenizers` library, which gets a space before the text. Side b: a `sentencepiece`
    model, which adds that space itself. Strings of special tokens are plain text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries]
        pieces = [(self.b.is_byte(i), self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if byte else p.replace("▁", " ").encode() for byte, p in pieces]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # Where no entry of side b goes on behind a space, it does not join across single spaces either.
        self.apart = not any("▁" in p.lstrip("▁") for _, p in pieces)
        self.recent = Pieces(KNOWN_PIECES)
        # An id as it is written inside its group and at the end of it, filled up with zero bytes.
        written = [f"{i}{end}" for n, ends in ((len(entries), ",|"), (len(pieces), ",;")) for end in ends for i in range(n)]
        self.written = np.array(written, "S")

    def _pieces_a(self, pieces: list[str], raw: list[bytes]) -> list[bytes | None]:
        """Ids of a space and each piece as little-endian numbers; None where they do not spell it. A space and a word may follow
        anything, so all such pieces are one text for the library."""
        out: list[bytes | None] = [None] * len(pieces)
        many = [i for i, p in enumerate(pieces) if p and not p[0].isspace()]
        text, ends = " ".join(["", *map(pieces.__getitem__, many)]), np.cumsum(_lengths([raw[i] for i in many]))
        ids = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        numbers = np.array(ids, ID)
        upto = np.cumsum(self.len_a[numbers])
        at = np.searchsorted(upto, ends)
        if b"".join(map(self.bytes_a.__getitem__, ids)) == text.encode() and (upto[at] == ends).all():
            data, start = numbers.tobytes(), 0
            for i, stop in zip(many, ((at + 1) * ID.itemsize).tolist()):
                out[i] = data[start:stop]
                start = stop
        rest = [i for i, found in enumerate(out) if found is None]
        for i, e in zip(rest, self.a.encode_batch_fast([f" {pieces[i]}" for i in rest], add_special_tokens=False)):
            if b"".join(map(self.bytes_a.__getitem__, e.ids)) == raw[i]:
                out[i] = packed(e.ids)
        return out

    def _pieces_b(self, pieces: list[str], raw: list[bytes]) -> list[bytes | None]:
        """The same for side b, which adds the space itself."""
        found = self.b.encode(pieces, num_threads=1)
        many = _lengths(found)
        ids = np.fromiter(chain.from_iterable(found), ID, many.sum())
        data, stops = ids.tobytes(), np.cumsum(many)
        spelled = b"".join(map(self.bytes_b.__getitem__, ids.tolist()))
        upto = np.concatenate(([0], np.cumsum(self.len_b[ids])))
        starts = upto[stops - many]
        lengths = upto[stops] - starts
        cut = [data[i:j] for i, j in zip(((stops - many) * ID.itemsize).tolist(), (stops * ID.itemsize).tolist())]
        if (lengths == _lengths(raw)).all() and spelled == b"".join(raw):
            return cut
        return [c if spelled[i : i + n] == r else None for c, i, n, r in zip(cut, starts.tolist(), lengths.tolist(), raw)]

    def _cut(self, text: str) -> list[str]:
        """The pieces of a text, without the spaces that stand before them."""
        if not self.apart:
            return [text]
        return _CUTS.split(text) if _RUNS.search(f" {text}") else text.split(" ")

    def _sides(self, strings: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both sides the ids of all spaces and texts, and how many each has: none if the ids of a side do not spell the text."""
        if not strings:
            return [_joined([])] * 2
        cut = list(map(self._cut, strings))
        many, pieces = np.fromiter(map(len, cut), np.int64, len(cut)), list(chain.from_iterable(cut))
        new = list(self.recent.missing(set(pieces)))
        raw = [f" {p}".encode() for p in new]
        found = list(zip(self._pieces_a(new, raw), self._pieces_b(new, raw)))
        wrong = {piece for piece, both in zip(new, found) if None in both}
        kept = [len(r) <= CACHED_BYTES and None not in both for r, both in zip(raw, found)]
        order = [i for i, k in enumerate(kept) if k] + (gone := [i for i, k in enumerate(kept) if not k])
        self.recent.add([new[i] for i in order], [_joined([found[i][side] or b"" for i in order]) for side in (0, 1)])
        places = np.fromiter(map(self.recent.now.__getitem__, pieces), np.int64, len(pieces))
        taken = [side.take(places) for side in self.recent.sides]
        out = [(ids, np.add.reduceat(counts, np.cumsum(many) - many)) for ids, counts in taken]
        self.recent.forget([new[i] for i in gone])
        if wrong:
            # What pieces do not spell is left to the libraries as a whole.
            texts = [[p.tobytes() for p in np.split(ids, np.cumsum(n)[:-1])] for ids, n in out]
            for i in [i for i, of_text in enumerate(cut) if not wrong.isdisjoint(of_text)]:
                whole = f" {strings[i]}".encode()
                both = (self._pieces_a([strings[i]], [whole])[0], self._pieces_b([strings[i]], [whole])[0])
                texts[0][i], texts[1][i] = (b"", b"") if None in both else both
            out = list(map(_joined, texts))
        return out

    def _side_a(self, strings: list[str]) -> list[bytes | None]:
        """Side a alone of what `_sides` gives, a text at a time."""
        ids, n = self._sides(strings)[0]
        return [p.tobytes() or None for p in np.split(ids, np.cumsum(n)[:-1])]

    def align(self, texts: list[bytes]) -> Slice:
        """Texts that are empty, or whose tokens of either side do not spell space and text, have no tokens."""
        full = [i for i, t in enumerate(texts) if t]
        sides = []
        for ids, n in self._sides([texts[i].decode() for i in full]):
            counts = np.zeros(len(texts), np.int64)
            counts[full] = n
            sides.append((ids, counts))
        return Slice(*sides, self.len_a, self.len_b)

    def group_texts(self, s: Slice) -> list[str]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`: ids in order, an empty text without tokens."""
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        last_a = np.append(s.group_a[1:] != s.group_a[:-1], True)[: len(s.a)]
        last_b = np.append(s.group_b[1:] != s.group_b[:-1], True)[: len(s.b)]
        codes = np.empty(len(s.a) + len(s.b), np.int64)
        codes[s.in_groups()] = np.concatenate((s.a + n_a * last_a, s.b + 2 * n_a + n_b * last_b))
        ends = np.cumsum(s.n_a + s.n_b)
        return [self.written[codes[i:j]].tobytes().replace(b"\0", b"")[:-1].decode() for i, j in zip((ends - s.n_a - s.n_b).tolist(), ends.tolist())]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for all tasks of a Python worker."""
    return Aligner(path_a, path_b)


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def group_lists(texts: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """The alignment itself: per row of `texts` its text, the ids of both sides, and for each group how many of each it has."""

    def run(batches):
        tool = aligner(path_a, path_b)
        for batch in batches:
            for start, stop in byte_slices(batch.column(0), CHUNK_BYTES):
                part = batch.column(0).slice(start, stop - start)
                s = tool.align(utf8_values(part))
                lists = [_lists(v, n, pa.int32()) for v, n in ((s.a, s.n_a), (s.b, s.n_b), (s.in_a, s.n_groups), (s.in_b, s.n_groups))]
                yield pa.RecordBatch.from_arrays([part.cast(pa.string()), *lists], names=["text", "a", "b", "in_a", "in_b"])

    return texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "text string, a array<int>, b array<int>, in_a array<int>, in_b array<int>")


def aligned(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """From (key, text, copies): a row per text with its measures and pairs of ids, and after those of each chunk a row without
    a key that has the chunk's distinct pairs and how many documents of the chunk hold each."""

    def run(batches):
        tool = aligner(path_a, path_b)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, stop in byte_slices(batch.column(1), CHUNK_BYTES):
                part = batch.slice(start, stop - start)
                s = tool.align(utf8_values(part.column(1)))
                text, pair, n = s.links
                _, of_chunk, copies = _summed(np.zeros_like(text), pair, part.column(2).to_numpy()[text])
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in tool.group_texts(s)]
                pairs = np.concatenate((pair, of_chunk))
                sizes = np.append(np.bincount(text, minlength=s.n), len(of_chunk))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk] * (s.n + 1), pa.int64()), pa.array([*part.column(0).to_pylist(), None], pa.binary()),
                        *(pa.array(np.append(getattr(s, m), 0), pa.int64()) for m in _MEASURES), pa.array([*digests, ""], pa.string()),
                        _lists(pairs >> _SHIFT, sizes, pa.int32()), _lists(pairs & ((1 << 32) - 1), sizes, pa.int32()),
                        _lists(np.concatenate((n, copies)), sizes, pa.int64()),
                    ],
                    names=["chunk", "key", *_MEASURES, "groups_sha256", "pair_a", "pair_b", "pair_n"],
                )
                chunk += 1
        pa.default_memory_pool().release_unused()  # the worker stays for later stages

    measures = ", ".join(f"{m} long" for m in _MEASURES)
    return texts.select("key", "text", "copies").mapInArrow(run, f"chunk long, key binary, {measures}, groups_sha256 string, {_PAIRS}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """From the rows of `aligned`: (a, b, docs, best): how many documents hold the pair, and whether no pair of that a is held by more."""
    counts = _chunk_pairs(rows).groupBy("a", "b").agg(F.sum("n").alias("docs"))
    highest = counts.groupBy("a").agg(F.max("docs").alias("highest"))
    return counts.join(highest, "a").select("a", "b", "docs", (F.col("docs") == F.col("highest")).alias("best"))


def _chunk_pairs(rows: DataFrame) -> DataFrame:
    zipped = F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p")
    pairs = rows.filter("key IS NULL").select("chunk", zipped)
    return pairs.select("chunk", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))


def _measured(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Measures per text, with those that need the counts of its pairs; a group is one chunk."""

    def run(texts: pa.Table, looked_up: pa.Table) -> pa.Table:
        known = looked_up.column("a").to_numpy().astype(np.int64) << _SHIFT | looked_up.column("b").to_numpy()
        order = np.argsort(known)
        known, docs = known[order], looked_up.column("docs").to_numpy()[order]
        best = looked_up.column("best").to_numpy(zero_copy_only=False)[order]
        lists = texts.column("pair_n").combine_chunks()
        a, b = (texts.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("pair_a", "pair_b"))
        n, sizes = lists.flatten().to_numpy(), pa.compute.list_value_length(lists).to_numpy()
        place = np.searchsorted(known, a << _SHIFT | b)
        of = np.repeat(np.arange(len(sizes)), sizes)
        n_best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        np.add.at(n_best, of, n * best[place])
        np.add.at(total, of, n * docs[place])
        kept = texts.select(["key", *_MEASURES])
        return kept.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(total)).append_column("groups_sha256", texts.column("groups_sha256"))

    longs = ", ".join(f"{c} long" for c in (*_MEASURES, "n_best", "count_sum"))
    texts = rows.filter("key IS NOT NULL").groupBy("chunk")
    return texts.cogroup(counts.groupBy("of_chunk")).applyInArrow(run, f"key binary, {longs}, groups_sha256 string")


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, tokens of both sides, groups, links, links that are the best of their a, the sum of the
    links' counts, and the digest of the groups.

    A null or empty text, and one that the tokens of a side do not spell, has zeros and no digest. Rows that repeat an id or a
    text count as documents each; null ids are kept. An empty table gives an empty table.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), text.alias("text"))
    distinct = rows.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    stored = written(aligned(distinct.withColumn("key", F.unhex(F.sha2("text", 256))), path_a, path_b), "aligned")
    counts = written(pair_counts(stored), "pair-counts")
    of_chunks = _chunk_pairs(stored).select(F.col("chunk").alias("of_chunk"), "a", "b").join(counts, ["a", "b"])
    measures = written(_measured(stored, of_chunks), "alignment-measures")
    keyed = rows.filter("text <> ''").select("doc", F.unhex(F.sha2("text", 256)).alias("key"))
    columns = [*_MEASURES, "n_best", "count_sum"]
    found = keyed.join(measures, "key").select(F.col("doc").alias(id_col), *columns, "groups_sha256")
    none = rows.filter("text IS NULL OR text = ''").select(
        F.col("doc").alias(id_col), *[F.lit(0).cast("long").alias(c) for c in columns], F.lit("").alias("groups_sha256")
    )
    return found.unionByName(none)
