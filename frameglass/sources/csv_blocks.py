"""CSV files with line breaks in quotes, cut into blocks that many tasks read.

Whether a line lies inside quotes depends on all lines before it. Each block says where it ends if it begins outside
quotes and where if it begins inside; from these, window sums give the true state at the begin of each block. With it a
task joins its lines to records. Records that cross an edge leave their blocks as fragments, a few per block, and are
put together at last. The records are parsed and written once as Parquet, so later passes read columns, not text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path


class QuoteRules:
    """Where a line ends, inside or outside quotes, by where it begins.

    A quote opens at the begin of a field only; inside, two quotes are one. After the closing quote all up to
    the next separator belongs to the field.
    """

    def __init__(self, sep: str, quote: str) -> None:
        if len(sep) != 1 or len(quote) != 1 or sep == quote or not (sep + quote).isascii():
            raise ValueError("separator and quote must be two different ASCII characters")
        s, q = re.escape(sep), re.escape(quote)
        held = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}[^{s}]*+"  # from inside quotes to the end of the field
        field = f"(?:{q}{held}|[^{q}{s}][^{s}]*+)?+"
        self.held = re.compile(held)
        self.fields = re.compile(f"(?:{field}{s})*+{field}")

    def ends_inside(self, line: str, inside: bool) -> bool:
        at = 0
        if inside:
            closed = self.held.match(line)
            if not closed:
                return True
            at = closed.end() + 1
        return at < len(line) and self.fields.match(line, at).end() < len(line)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """(file, block), first and last row of each stretch of rows of one block."""
    if not batch.num_rows:
        return
    file, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield (int(file[a]), int(block[a])), a, b


def block_ends(lines: DataFrame, rules: QuoteRules, quote: str) -> DataFrame:
    """(file, block, from_out, from_in): whether a block ends inside quotes, by where it begins.

    `lines` holds the lines of a block in their order, one block after another in each partition. Of lines
    without a quote only the place is passed to Python.
    """

    def run(batches):
        at, state = None, [0, 1]
        for batch in batches:
            for key, a, b in _runs(batch):
                if key != at:
                    if at is not None:
                        yield row(at, state)
                    at, state = key, [0, 1]
                for line in batch.column(2).slice(a, b - a).drop_null().to_pylist():
                    ends = [int(rules.ends_inside(line, bool(x))) for x in sorted(set(state))]
                    state = ends * 2 if state[0] == state[1] else [ends[x] for x in state]
        if at is not None:
            yield row(at, state)

    def row(key, state):
        return pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "from_out": state[0], "from_in": state[1]}])

    quoted = lines.select("file", "block", F.when(F.contains("value", F.lit(quote)), F.col("value")).alias("value"))
    return quoted.mapInArrow(run, "file long, block long, from_out long, from_in long")


def block_starts(ends: DataFrame) -> DataFrame:
    """(file, block, inside): whether a block begins inside quotes.

    A block that ends alike from either side fixes the state; since the last such block, those that turn it are counted.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when((F.col("from_out") == 1) & (F.col("from_in") == 0), 1).otherwise(0)
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct("from_out", "so_far"))
    return (
        ends.withColumn("so_far", F.sum(turns).over(order))
        .withColumn("known", F.last(fixed, ignorenulls=True).over(before))
        .withColumn("turned", F.coalesce(F.sum(turns).over(before), F.lit(0)))
        .select("file", "block", F.expr("coalesce(known.from_out + turned - known.so_far, turned) % 2 = 1").alias("inside"))
    )


#: Fragments: the rest of a record that began in an earlier block, and the begin of one that this block does not end.
REST, BEGIN = 0, 1
_RECORD = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("first", pa.bool_()), ("record", pa.string())])


def block_records(lines: DataFrame, rules: QuoteRules, quote: str) -> DataFrame:
    """(file, block, part, first, record): records, and as `part` the fragments at the edges of blocks.

    `lines` as in `block_ends`, with `inside` of their block. `first` marks the first record of a file that is not
    empty. A record is held in memory; blocks and files are not.
    """

    def run(batches):
        at, inside, held, rest, fresh = None, False, [], False, False
        for batch in batches:
            values = batch.column(2).cast(pa.string())
            for key, a, b in _runs(batch):
                if key != at:
                    if at is not None and inside:
                        yield fragment(at, REST if rest else BEGIN, fresh, held)
                    at, held, fresh = key, [], key[1] == 0
                    inside = rest = batch.column(3)[a].as_py()
                part = values.slice(a, b - a)
                quoted = np.flatnonzero(pc.match_substring(part, quote).to_numpy(zero_copy_only=False))
                after = np.empty(len(part), bool)
                done = 0
                for i in quoted.tolist():
                    after[done:i] = inside
                    inside = after[i] = rules.ends_inside(part[i].as_py(), inside)
                    done = i + 1
                after[done:] = inside
                ends = np.flatnonzero(~after) + 1
                begin = 0
                if len(ends) and (held or rest):  # the record that an earlier batch or block left open
                    begin = int(ends[0])
                    held += part.slice(0, begin).to_pylist()
                    yield fragment(at, REST if rest else None, fresh, held)
                    fresh, held, rest, ends = fresh and rest, [], False, ends[1:]
                if len(ends):
                    spans = pa.ListArray.from_arrays(pa.array([begin, *ends.tolist()], pa.int32()), part)
                    texts = pc.binary_join(spans, "\n")
                    first = np.zeros(len(texts), bool)
                    if fresh:
                        filled = next((i for i, t in enumerate(texts) if t.as_py().strip("\r")), None)
                        if filled is not None:
                            first[filled], fresh = True, False
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, at[0])), pa.array(np.full(n, at[1])), pa.nulls(n, pa.int32()), pa.array(first), texts], schema=_RECORD
                    )
                    begin = int(ends[-1])
                held += part.slice(begin).to_pylist()
        if at is not None and inside:
            yield fragment(at, REST if rest else BEGIN, fresh, held)

    def fragment(key, part, fresh, held):
        first = fresh and part != REST
        return pa.RecordBatch.from_pylist(
            [{"file": key[0], "block": key[1], "part": part, "first": first, "record": "\n".join(held)}], schema=_RECORD
        )

    return lines.select("file", "block", "value", "inside").mapInArrow(run, "file long, block long, part int, first boolean, record string")


def stitched(fragments: DataFrame) -> DataFrame:
    """(first, record): the records that fragments make, by the order of blocks."""
    order = Window.partitionBy("file").orderBy("block", "part")
    return (
        fragments.withColumn("chain", F.sum("part").over(order))  # a begin counts one, a rest nothing
        .groupBy("file", "chain")
        .agg(F.bool_or("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "part", "record"))).alias("parts"))
        .select("first", F.array_join(F.col("parts.record"), "\n").alias("record"))
    )


def stage_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """All columns of CSV files as text, as `read_texts` gives them before missing tokens, staged as Parquet.

    Files are cut at any line (`spark.sql.files.maxPartitionBytes`), also those with line breaks in quotes. The
    text is scanned twice, first for quotes alone. Each file has a header; the names are those of the first one. Lines end with a
    line feed, with or without a carriage return before it; text is UTF-8. Compressed files stay one block each.
    Broadcast is a row per block: 24 bytes for each 128 MB of text at Spark's default. The copy stays below
    `spark.checkpoint.dir`; folders with partition columns are refused.
    """
    rules = QuoteRules(sep, quote)
    settings = {"sep": sep, "quote": quote, "escape": quote}
    names = spark.read.options(header=True, multiLine=True, **settings).csv(path).columns
    raw = spark.read.option("lineSep", "\n").text(path)
    if raw.columns != ["value"]:
        raise ValueError(f"partition columns {raw.columns[1:]} cannot be staged")
    lines = raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    starts = block_starts(block_ends(lines, rules, quote))
    # Both scans must be cut alike; a block that the first one did not see stops the job.
    known = F.coalesce("inside", F.raise_error(F.lit("files were cut anew between two scans")).cast("boolean"))
    placed = lines.join(F.broadcast(starts), ["file", "block"], "left").withColumn("inside", known)
    width = ", ".join(f"c{i} STRING" for i in range(len(names)))
    columns = [F.col(f"row.c{i}").alias(f"c{i}") for i in range(len(names))]

    def parsed(records: DataFrame, *more: str) -> DataFrame:
        """The columns of records that are no header and not empty, and of fragments none."""
        rows = records.withColumn("bare", F.expr("CASE WHEN endswith(record, '\\r') THEN left(record, length(record) - 1) ELSE record END"))
        rows = rows.where("part IS NOT NULL OR (NOT first AND bare <> '')")
        text = F.when(F.col("part").isNull(), F.col("bare"))
        return rows.withColumn("row", F.from_csv(text, width, settings)).select(*more, *columns)

    copy = scratch_path(spark, "csv-rows")
    held = F.when(F.col("part").isNotNull(), F.col("record"))
    parsed(block_records(placed, rules, quote).withColumn("held", held), "file", "block", "part", "first", "held").write.parquet(copy)
    staged = spark.read.parquet(copy)
    places = [f"c{i}" for i in range(len(names))]
    fragments = staged.where("part IS NOT NULL").selectExpr("file", "block", "part", "first", "held AS record")
    crossing = parsed(stitched(fragments).withColumn("part", F.lit(None).cast("int")))
    return staged.where("part IS NULL").select(*places).unionByName(crossing).toDF(*names)
