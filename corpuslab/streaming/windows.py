"""Event-time operators for Structured Streaming; each also runs on a batch frame."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_event_time(df: DataFrame, column: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Event time as a zoned timestamp, with a watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def tumbling(df: DataFrame, column: str = "ts", size: str = "1 hour", *keys: str) -> DataFrame:
    w = F.window(column, size)
    out = df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sliding(df: DataFrame, column: str = "ts", size: str = "1 hour", hop: str = "30 minutes", *keys: str) -> DataFrame:
    w = F.window(column, size, hop)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, key: str, column: str = "ts", gap: str = "10 minutes") -> DataFrame:
    w = F.session_window(column, gap)
    return df.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, within the watermark; on a batch frame, once at all."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over a Parquet table, one file or a folder of files, with its own schema."""
    path = f"{folder}/{name}.parquet"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(path)


def run_to_end(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over what is there now, into Parquet, and read the result.

    Offsets and state live in the checkpoint under ``folder``; a second call goes
    on where the first one ended.
    """
    query = df.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def progress(query) -> dict:
    """Rows in and state rows of a query's last batch, for counters that pass through."""
    last = query.lastProgress or {}
    last = last if isinstance(last, dict) else json.loads(last.json)
    return {"rows": last.get("numInputRows", 0), "state": sum(s.get("numRowsTotal", 0) for s in last.get("stateOperators", []))}


def state_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a query's result and state, in the shared folder; where none is set, on a local master alone, a temporary one."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(root or "file://" + tempfile.mkdtemp(prefix="corpuslab-"), f"{name}-{uuid.uuid4().hex}")
