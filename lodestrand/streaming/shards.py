"""Structured Streaming over immutable shards and metric lines, with cursors as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestrand.functions.text import owner_of
from lodestrand.schemas import METRICS


def stream_documents(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """New shards' document lines as they appear, with the shard they come from."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return rows.withColumn("shard", F.col("_metadata.file_path"))


def stream_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(METRICS).json(path)


def for_worker(stream: DataFrame, record: str, rank: int, world_size: int) -> DataFrame:
    """The rows that one of world_size workers owns; over all workers each row once."""
    if not 0 <= rank < world_size:
        raise ValueError("need 0 <= rank < world_size")
    return stream.where(owner_of(F.col(record), world_size) == rank)


def ordinary(stream: DataFrame, text: str = "text") -> DataFrame:
    """Without compiler-harness texts."""
    return stream.where(~F.col(text).rlike(r"(?m)^[ \t]*// @(?:Filename|BaselineFile):"))


def drain(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], manifest: dict[str, str] | None = None) -> StreamingQuery:
    """Runs over what is there, then ends. Offsets are committed after `write` returns, so a rerun repeats at most the
    last batch. manifest: sha256 by shard; a batch with a shard that isn't in it fails before anything is written."""

    def batch(df: DataFrame, number: int) -> None:
        if manifest is not None:
            strange = [r["shard"] for r in df.select("shard").distinct().collect() if r["shard"].rsplit("/", 1)[-1] not in manifest]
            if strange:
                raise ValueError(f"shards outside the manifest: {strange[:3]}")
        write(df, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
