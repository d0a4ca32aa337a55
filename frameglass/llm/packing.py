"""Packing token sequences by minimum bin slack.

A document's whole windows of `capacity` ids go out as they are. Its rest joins the pool of its task.
For each window the largest rest is set first, and dynamic programming over the multiset of
the remaining lengths finds the sum closest to the space that is left: one Python integer holds all
reachable sums as bits, a length with its multiplicity is a few shifts of it, and walking back through
the shifts gives how often each length is used. The same filling is repeated while its
lengths last. A window that no multiset fills within `max_slack` is completed by cutting a rest, and the
last window of a task is cut at powers of two, where no padding is needed.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import byte_slices, utf8_values
from .tokens import crc32, encoder, packed

CAPACITY = 4096
#: Ids of padding that are accepted rather than cutting a document.
MAX_SLACK = 4
#: Ids that wait in a task's pool before windows are filled.
POOL_IDS = 2_000_000


def fill(counts: dict[int, int], space: int) -> tuple[int, dict[int, int]]:
    """The sum of a sub-multiset closest to `space` from below, and how often it uses each length."""
    reachable, steps = 1, []
    within = (1 << (space + 1)) - 1
    for length in sorted((n for n in counts if n <= space), reverse=True):
        left, block = min(counts[length], space // length), 1
        while left:
            take = min(block, left)
            steps.append((length, take, reachable))
            reachable |= (reachable << (length * take)) & within
            left, block = left - take, block * 2
        if reachable >> space & 1:
            break
    best = total = reachable.bit_length() - 1
    used: Counter = Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return best, dict(used)


class Packer:
    """Packs the documents of one task. Pieces are (doc, start, document's ids, ids as bytes)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, max_slack: int = MAX_SLACK):
        self.capacity, self.max_slack, self.sequence = capacity, max_slack, first_sequence
        self.rests: dict[int, list] = defaultdict(list)
        self.waiting = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            self.out.append((doc, start, total, ids, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def _keep(self, piece: tuple) -> None:
        n = len(piece[3]) // 4
        self.rests[n].append(piece)
        self.waiting += n

    def _take(self, length: int) -> tuple:
        pieces = self.rests[length]
        piece = pieces.pop()
        if not pieces:
            del self.rests[length]
        self.waiting -= length
        return piece

    def add(self, doc, ids: bytes) -> None:
        total, step = len(ids) // 4, self.capacity * 4
        for at in range(0, len(ids), step):
            piece = (doc, at // 4, total, ids[at : at + step])
            if len(piece[3]) == step:
                self._emit([piece])
            else:
                self._keep(piece)

    def _cut(self, piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc, start, total, ids = piece
        return (doc, start, total, ids[: 4 * n]), (doc, start + n, total, ids[4 * n :])

    def pack(self, until: int) -> None:
        """Fill windows until at most `until` ids wait; 0 also sends out the last, partly filled window."""
        while self.waiting > until:
            if self.waiting < self.capacity:
                if until:
                    return
                self._powers([self._take(n) for n in sorted(self.rests, reverse=True) for _ in range(len(self.rests[n]))])
                return
            seed = max(self.rests)
            counts = {n: len(p) for n, p in self.rests.items()}
            counts[seed] -= 1
            space = self.capacity - seed
            best, used = fill({n: c for n, c in counts.items() if c}, space)
            used[seed] = used.get(seed, 0) + 1
            slack = space - best
            whole = slack <= self.max_slack
            for _ in range(min(len(self.rests[n]) // c for n, c in used.items()) if whole else 1):
                window = [self._take(n) for n, c in used.items() for _ in range(c)]
                if not whole:  # every rest that is left is longer than the slack
                    head, tail = self._cut(self._take(max(self.rests)), slack)
                    window.append(head)
                    self._keep(tail)
                self._emit(window)

    def _powers(self, pieces: list[tuple]) -> None:
        left = sum(len(p[3]) for p in pieces) // 4
        if self.capacity - left <= self.max_slack:
            self._emit(pieces)
            return
        while left:
            space = 1 << (left.bit_length() - 1)
            left -= space
            window = []
            while space:
                piece = pieces.pop(0)
                if len(piece[3]) // 4 > space:
                    piece, tail = self._cut(piece, space)
                    pieces.insert(0, tail)
                window.append(piece)
                space -= len(piece[3]) // 4
            self._emit(window)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    max_slack: int = MAX_SLACK,
    pool_ids: int = POOL_IDS,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless
    `with_ids` is false, the ids themselves.

    Every task packs the documents it reads, with a pool of bounded size and without a shuffle; sequence ids
    begin at the task's number times 2**32. A null text is empty and gives its end id. Rows that repeat an id
    are packed each. An empty table gives no piece.
    """
    end = packed([end_id])
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(packer: Packer, id_type: pa.DataType) -> pa.RecordBatch:
        out, packer.out = packer.out, []
        docs_, starts, totals, ids, sequences, offsets = ([p[k] for p in out] for k in range(6))
        columns = {
            "doc_id": pa.array(docs_, id_type),
            "start": pa.array(starts, pa.int64()),
            "length": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_crc32": pa.array(map(crc32, ids), pa.int64()),
            "doc_tokens": pa.array(totals, pa.int64()),
            "sequence_id": pa.array(sequences, pa.int64()),
            "offset": pa.array(offsets, pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array(ids, pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    def run(batches):
        enc = encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, max_slack)
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for start, stop in byte_slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(utf8_values(part.column(1)))):
                    packer.add(doc, ids + end)
                if packer.waiting >= pool_ids:
                    packer.pack(pool_ids // 4)
                if packer.out:
                    yield rows(packer, id_type)
        packer.pack(0)
        if packer.out:
            yield rows(packer, id_type)

    schema = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + (", ids binary" if with_ids else "")
    )
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)
