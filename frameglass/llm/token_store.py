"""Token ids as Parquet list columns that can be read selectively.

Files are sorted by document id. Ids are dictionary encoded (a vocabulary fits one dictionary page),
the sorted document ids and the counts delta encoded. Row groups and pages are small enough for the
page index to lead a reader to the rows it asks for, and counts are a column of their own, so
questions about lengths never read ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import ID, crc32, encoder, packed
from .texts import byte_slices, utf8_values

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES, PAGE_ROWS = 256 << 10, 2_000
#: Rows of a file whose starts are summed up in one group.
RUN_ROWS = 100_000

WRITER = {
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding of integers without dictionary
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


def _lists(parts: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
    values = np.frombuffer(b"".join(parts), dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and tokens of every row; the end id is counted. A null text gives the end id alone."""
    end = packed([end_id])

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for start, stop in byte_slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                ids = [x + end for x in enc.encode(utf8_values(part.column(1)))]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), counts, _lists(ids)], names=["doc_id", "n_tokens", "tokens"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, tokens array<int>")


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Write the ids of all rows below `path` in ascending document order, file by file.

    Rows of one document id lie one after another, in the order of their texts' digests, null ids first; a hot id may
    go on in the next file. An empty table writes an empty one.
    """
    ordered = (
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
        .withColumn("digest", F.xxhash64("text"))
        .repartitionByRange("doc_id", "digest")
        .sortWithinPartitions("doc_id", "digest")
    )
    limits = {
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
    }
    encode(ordered, tokenizer, end_id).write.options(**WRITER, **limits).parquet(path)


def file_number() -> Column:
    """The place of a row's file among the files in ascending order."""
    name = F.col("_metadata.file_name")
    part = F.regexp_extract(name, r"^part-(\d+)-", 1).cast("long")
    return part * 1_000_000 + F.regexp_extract(name, r"-c(\d+)\.", 1).cast("long")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The stored rows, or those of a range of ids: row groups and pages outside it are not read."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows


def stored_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per stored row: doc_id, start (ids of all rows before it), n_tokens and ids_crc32, all from the files.

    Where a run of rows starts follows from the counts alone; rows lie in their file as they are numbered there, so
    `start` is the place of a row's ids also where several rows have one id or none.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(ID, copy=False)
            crcs = [crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64())],
                names=["file_no", "row_no", "doc_id", "n_tokens", "ids_crc32"],
            )

    stored = spark.read.parquet(path)
    kind = stored.schema["doc_id"].dataType.simpleString()
    place = [file_number().alias("file_no"), F.col("_metadata.row_index").alias("row_no")]
    rows = stored.select(*place, "doc_id", "tokens").mapInArrow(
        run, f"file_no long, row_no long, doc_id {kind}, n_tokens long, ids_crc32 long"
    )
    # Files and runs of rows in them are summed first, so that ids before a row are counted in bounded parts.
    rows = rows.withColumn("run", F.floor(F.col("row_no") / RUN_ROWS))
    counts = stored.select(*place, "n_tokens").groupBy("file_no", F.floor(F.col("row_no") / RUN_ROWS).alias("run")).agg(F.sum("n_tokens").alias("ids"))
    earlier = Window.orderBy("file_no", "run").rowsBetween(Window.unboundedPreceding, 0)  # a row per run
    starts = counts.select("file_no", "run", (F.sum("ids").over(earlier) - F.col("ids")).alias("run_start"))
    in_run = Window.partitionBy("file_no", "run").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("upto", F.sum("n_tokens").over(in_run))
    return running.join(starts, ["file_no", "run"]).select(
        "doc_id", (F.col("run_start") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32"
    )
