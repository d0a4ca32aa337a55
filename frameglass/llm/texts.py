"""Small text helpers shared by the operators of this folder."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python that works on lists of words takes texts in slices of about this many bytes, so that
#: memory does not follow the size of Arrow batches. One text is never cut.
SLICE_BYTES = 2_000_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of plain ASCII take the fast built-in."""
    translated = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(text.rlike(r"[^\x00-\x7F]"), translated).otherwise(F.lower(text))


def ascii_lower_bytes(data: bytes) -> bytes:
    """The same for UTF-8 bytes: `bytes.lower` changes A-Z only."""
    return data.lower()


def utf8_values(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Cut row numbers into runs (start, end) of about `limit` bytes; a longer text is a run of its own."""
    start = held = 0
    for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
        n = n or 0
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if len(column) > start:
        yield start, len(column)
