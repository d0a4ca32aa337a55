"""JSON documents cut into blocks that many tasks read, also those without any line break.

A document is read as pieces that end at closing braces, which Spark's text reader cuts anywhere in a file. What a piece
does depends on whether it begins inside a string: each block says for both cases how far it goes down in the
document and whether it ends inside. From that, window sums give the true state at the begin of each block. With it a
task joins its pieces to the items of a root array. Items that cross an edge leave their blocks as fragments,
at most two per block, and are put together at last.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .csv_blocks import BEGIN, REST, _runs

ROOT_ERROR = "a JSON document must hold an array or an object"
ITEM, DOCUMENT, FRAGMENT = "item", "document", "fragment"


def json_pieces(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, block, value, flips, out, in, mark, size): texts between closing braces, in their order.

    `flips` is 1 if a piece holds an odd number of quotes. `out` and `in` are the levels it goes down, the brace
    after it included, if it begins outside or inside a string. `mark` is the first sign of a document.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    if raw.columns != ["value"]:
        raise ValueError(f"partition columns {raw.columns[1:]} cannot be staged")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    count = lambda text, signs: F.length(text) - F.length(F.translate(text, signs, ""))
    flips = count(bare, '"') % 2

    def levels(text: Column, closes: Column) -> Column:
        structure = F.regexp_replace(text, r'"[^"]*+"?', "")
        return (count(structure, "{[") - count(structure, "]") - closes).cast("long")

    return raw.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
        flips.cast("long").alias("flips"),
        levels(bare, 1 - flips).alias("out"),
        levels(F.concat(F.lit('"'), bare), flips).alias("in"),
        F.when(F.col("_metadata.file_block_start") == 0, F.regexp_extract("value", r"^\s*(\S?)", 1)).alias("mark"),
        F.col("_metadata.file_size").alias("size"),
    )


def _walk(flips: np.ndarray, out: np.ndarray, inner: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each piece ends inside a string, and the levels it goes down, by where the first one begins."""
    after = (inside + np.cumsum(flips)) % 2
    before = np.concatenate([[inside], after[:-1]])
    return after, np.where(before, inner, out)


_NAMES = ("file", "block", "flips", "out", "in", "mark", "size", "bytes")
_EFFECT = pa.schema([(name, pa.string() if name == "mark" else pa.int64()) for name in _NAMES])


def block_effects(pieces: DataFrame) -> DataFrame:
    """(file, block, flips, out, in, mark, size, bytes): what a block does as a whole; no text is passed to Python."""

    def run(batches):
        at = held = None
        for batch in batches:
            for key, a, b in _runs(batch):
                if key != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pylist([held], schema=_EFFECT)
                    at, held = key, {"file": key[0], "block": key[1], "flips": 0, "out": 0, "in": 0}
                    held |= {"mark": batch.column(5)[a].as_py(), "size": batch.column(6)[a].as_py(), "bytes": 0}
                part = batch.slice(a, b - a)
                flips, out, inner, size = (part.column(i).to_numpy() for i in (2, 3, 4, 7))
                for name, begin in (("out", 0), ("in", 1)):
                    held[name] += int(_walk(flips, out, inner, begin ^ held["flips"])[1].sum())
                held["flips"] = int(held["flips"] + flips.sum()) % 2
                held["bytes"] += int(size.sum())
        if at is not None:
            yield pa.RecordBatch.from_pylist([held], schema=_EFFECT)

    measured = pieces.select("file", "block", "flips", "out", "in", "mark", "size", (F.octet_length("value") + 1).cast("long").alias("bytes"))
    return measured.mapInArrow(run, "file long, block long, flips long, out long, in long, mark string, size long, bytes long")


def block_starts(effects: DataFrame) -> DataFrame:
    """(file, block, inside, depth, mark, broken): the state at the begin of each block, the first sign of the file, and
    whether the file ends inside a string or a level.

    The brace counted after the last piece of a file is there only if the pieces make up the size of the file;
    of compressed files, whose size is another one, both ends are let pass.
    """
    order = Window.partitionBy("file").orderBy("block")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    end, surplus = F.sum("levels").over(whole), F.sum("bytes").over(whole) - F.col("size")
    closed = F.when(surplus == 1, end == -1).when(surplus == 0, end == 0).otherwise(end.isin(0, -1))
    return (
        effects.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1)
        .withColumn("levels", F.when(F.col("inside"), F.col("in")).otherwise(F.col("out")))
        .select(
            "file", "block", "inside",
            F.coalesce(F.sum("levels").over(before), F.lit(0)).alias("depth"),
            F.first("mark").over(order).alias("mark"),
            (~closed | (F.sum("flips").over(whole) % 2 == 1)).alias("broken"),
        )
    )


RECORD = "file long, block long, part int, listed boolean, record string"
_RECORD = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("listed", pa.bool_()), ("record", pa.string())])


def block_records(pieces: DataFrame) -> DataFrame:
    """(file, block, part, listed, record): items of root arrays (`listed`) and whole documents of other roots, and as
    `part` the fragments at the edges of blocks.

    `pieces` as in `json_pieces`, with `inside`, `depth` and `mark` of their block. A record is held in memory; blocks
    and files are not.
    """

    def run(batches):
        at, held, rest, inside, depth, listed = None, [], False, 0, 0, False
        for batch in batches:
            values = batch.column(2).cast(pa.string())
            for key, a, b in _runs(batch):
                if key != at:
                    if held:
                        yield fragment(at, REST if rest else BEGIN, listed, held)
                    at, held = key, []
                    inside, depth, listed = (batch.column(i)[a].as_py() for i in (6, 7, 8))
                    inside = int(inside)
                    rest = key[1] > 0 and (inside == 1 or depth != int(listed))
                part = values.slice(a, b - a)
                flips, out, inner = (batch.column(i).slice(a, b - a).to_numpy() for i in (3, 4, 5))
                after, levels = _walk(flips, out, inner, inside)
                depths = depth + np.cumsum(levels)
                ends = np.flatnonzero((depths == int(listed)) & (after == 0)) + 1
                inside, depth = int(after[-1]), int(depths[-1])
                begin = 0
                if len(ends) and (held or rest):  # the record that an earlier batch or block left open
                    begin = int(ends[0])
                    held += part.slice(0, begin).to_pylist()
                    yield fragment(at, REST if rest else None, listed, held)
                    held, rest, ends = [], False, ends[1:]
                if len(ends):
                    spans = pa.ListArray.from_arrays(pa.array([begin, *ends.tolist()], pa.int32()), part)
                    texts = pc.binary_join_element_wise(pc.binary_join(spans, "}"), "}", "")
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, at[0])), pa.array(np.full(n, at[1])), pa.nulls(n, pa.int32()), pa.array(np.full(n, listed)), texts], schema=_RECORD
                    )
                    begin = int(ends[-1])
                held += part.slice(begin).to_pylist()
        if held:
            yield fragment(at, REST if rest else BEGIN, listed, held)

    def fragment(key, part, listed, held):
        text = "".join(piece + "}" for piece in held)
        return pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "part": part, "listed": listed, "record": text}], schema=_RECORD)

    placed = pieces.select("file", "block", "value", "flips", "out", "in", "inside", "depth", (F.col("mark") == "[").alias("listed"))
    return placed.mapInArrow(run, RECORD)


def stitched(fragments: DataFrame) -> DataFrame:
    """The records that fragments make, by the order of blocks, as `block_records` gives them; what closes a document is none."""
    order = Window.partitionBy("file").orderBy("block", "part")
    joined = (
        fragments.withColumn("chain", F.sum("part").over(order))  # a begin counts one, a rest nothing
        .groupBy("file", "chain")
        .agg(F.bool_or("listed").alias("listed"), F.sort_array(F.collect_list(F.struct("block", "part", "record"))).alias("parts"))
        .select("file", F.col("parts.block")[0].alias("block"), F.lit(None).cast("int").alias("part"), "listed", F.array_join(F.col("parts.record"), "").alias("record"))
    )
    closing = F.when(F.col("listed"), F.rlike("record", F.lit(r"^\s*(\[\s*)?\]\s*\}$"))).otherwise(F.rlike("record", F.lit(r"^\s*\}$")))
    return joined.where(~closing)


def _lines(records: DataFrame) -> DataFrame:
    """(kind, value): a record on one line, an item without the sign before it; anything else there stops the job.
    A fragment is kept as it is, with its place."""
    flat = F.translate("record", "\r\n", "  ")  # strings of JSON hold no raw line breaks
    item = F.when(F.rlike(flat, F.lit(r"^\s*[\[,]\s*\{")), F.regexp_replace(flat, r"^\s*[\[,]\s*", "")).otherwise(
        F.raise_error(F.lit("items of a root array must be objects, with commas between them"))
    )
    part, listed = F.col("part").isNotNull(), F.col("listed")
    kind = F.when(part, F.lit(FRAGMENT)).when(listed, F.lit(ITEM)).otherwise(F.lit(DOCUMENT))
    value = F.when(part, F.to_json(F.struct("file", "block", "part", "listed", "record"))).when(listed, item).otherwise(flat)
    return records.select(kind.alias("kind"), value.alias("value"))


def _kinds(spark: SparkSession, copy: str) -> dict[str, str]:
    """The folders of each kind that was written."""
    written = spark.read.text(copy).inputFiles()
    return {k: f"{copy}/kind={k}" for k in (ITEM, DOCUMENT, FRAGMENT) if any(f"/kind={k}/" in name for name in written)}


def stage_json(spark: SparkSession, path: str | Sequence[str]) -> dict[str, str]:
    """Folders of JSON Lines by kind: `item` of the items of root arrays, `document` of root objects, if there are any.

    Files are cut at any closing brace (`spark.sql.files.maxPartitionBytes`), so a task holds an item, never a
    document, unless its root is an object: that is one record. The text is scanned twice and the
    records are written below `spark.checkpoint.dir`. Text is UTF-8. Compressed files stay one block each; empty
    files give nothing; items that are no objects and documents that do not end as they should raise an error. Broadcast is a
    row per block: about 40 bytes for each 128 MB of text at Spark's default.
    """
    pieces = json_pieces(spark, path)
    states = scratch_path(spark, "json-blocks")
    block_starts(block_effects(pieces)).write.parquet(states)
    starts = spark.read.parquet(states)
    roots = starts.groupBy("mark").agg(F.bool_or("broken").alias("broken"), F.count_if(F.col("block") == 0).alias("n")).limit(3).collect()
    if not roots or not {r["mark"] for r in roots} <= {"[", "{"}:
        raise ValueError(ROOT_ERROR)
    if any(r["broken"] for r in roots):
        raise ValueError("a JSON document does not end as it should")
    # Both scans must be cut alike; a block that the first one did not see stops the job.
    known = F.coalesce("depth", F.raise_error(F.lit("files were cut anew between two scans")).cast("long"))
    placed = pieces.drop("mark").join(F.broadcast(starts), ["file", "block"], "left").withColumn("depth", known)
    copy = scratch_path(spark, "json-rows")
    _lines(block_records(placed)).write.partitionBy("kind").text(copy)
    found = _kinds(spark, copy)
    if FRAGMENT in found:
        held = spark.read.schema(RECORD).json(found[FRAGMENT])
        _lines(stitched(held)).write.mode("append").partitionBy("kind").text(copy)
        found = _kinds(spark, copy)
        found.pop(FRAGMENT)
    documents = spark.read.text(found[DOCUMENT]).count() if DOCUMENT in found else 0
    if documents != sum(r["n"] for r in roots if r["mark"] == "{"):
        raise ValueError("a file must hold one JSON document and nothing after it")
    return found
