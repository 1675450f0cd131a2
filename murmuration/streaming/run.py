"""Runs a streaming query over everything that is there and gives its output as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="murmuration-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str, files: int = 1000) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events*.parquet")


def drained(stream: DataFrame) -> DataFrame:
    """Runs the stream until its input is used up; every batch is appended to a Parquet table in the shared folder."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
