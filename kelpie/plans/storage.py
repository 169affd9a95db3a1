"""Where iterative operators cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; only a local session that lacks it gets a folder of its own."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


def shared_root(spark: SparkSession) -> str:
    """The folder of checkpoints."""
    ensure_checkpoints(spark)
    return (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")).rstrip("/")


def stored_at(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that path."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def cut(frame: DataFrame, *by: str) -> DataFrame:
    """The frame written to the folder of checkpoints, in folders by some columns if given, and read back. Unlike a checkpoint it is computed once and is planned by its
    own size: checkpoints keep the size guessed for their plan, which in a loop of joins doubles its digits with each round."""
    path = f"{shared_root(frame.sparkSession)}/cut-{uuid.uuid4().hex}"
    (frame.write.partitionBy(*by) if by else frame.write).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
