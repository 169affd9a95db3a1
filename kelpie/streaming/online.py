"""Micro-batches whose results are kept by batch, so that a batch that runs again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kelpie.plans.storage import stored_at


def by_batch(path: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: the batch's results replace those that the same batch wrote before."""

    def step(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def arriving(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its files. A pattern as path takes a single file as well as a folder of them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def state(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The last result of each key; rows of one batch that share a key are told apart by nothing, so a batch should have one."""
    if not stored_at(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    names = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("last")).select(key, "last.*")


def started(stream: DataFrame, path: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run the work on all that a stream has now, in batches; the batches done are remembered beside the results."""
    return stream.writeStream.foreachBatch(by_batch(f"{path}/results", work)).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
