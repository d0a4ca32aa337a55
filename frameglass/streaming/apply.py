"""Apply a fitted chain to a stream of new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.chain import Chain
from ..session import scratch_path


def transform_stream(chain: Chain, stream: DataFrame) -> DataFrame:
    """A fitted chain holds no state, so a stream needs neither watermark nor store."""
    if not stream.isStreaming:
        raise ValueError("a streaming DataFrame is needed; use Chain.transform on a table")
    return chain.transform(stream)


def score_available(
    spark: SparkSession,
    chain: Chain,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str | None = None,
    fmt: str = "parquet",
    max_files: int = 1_000,
) -> DataFrame:
    """Transform all files of a folder not yet seen and append them to `target`.

    Progress is kept in `checkpoint`, so a rerun after a loss goes on with the files
    that are left and writes each once. `max_files` bounds a micro-batch.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(source)
    scored = transform_stream(chain, stream)
    query = (
        scored.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream"))
        .option("path", target)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(scored.schema).parquet(target)
