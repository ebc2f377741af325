"""Vectors that arrive as a stream, assigned to shards whose centres are known.

The assignment is the batch operator's map over Arrow batches, which needs no
state, so a stream takes the same plan and late rows need no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from velora.operators.partition import partition_knearest


def read_vectors(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files (vec_id, embedding) that appear in a folder."""
    return spark.readStream.schema("vec_id long, embedding array<float>").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def assign_stream(vectors: DataFrame, centers: DataFrame, path: str, checkpoint: str, *, copies: int = 1, once: bool = False) -> StreamingQuery:
    """Append shard_id, vec_id, round, dist to a Parquet table by shard; once: what is there now, then stop."""
    out = partition_knearest(vectors, centers, copies).writeStream.format("parquet").partitionBy("shard_id").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
