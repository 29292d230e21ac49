"""Event streams: windowed counts, sessions, first-seen events, latest state (append to tables in the shared folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch

LATE = "2 hours"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The event table as a stream, its times as instants so that watermarks apply."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory():
        stream = reader.parquet(f"{folder}/{name}")
    else:
        stream = reader.option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def tumbling_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    counts = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    found = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, *keys: str) -> DataFrame:
    """Idempotent intake: a key is let through once."""
    return events.dropDuplicates(list(keys))


def latest_state(events: DataFrame, key: str) -> DataFrame:
    last = F.max_by(F.struct("ts", "event_id", "event_type"), F.struct("ts", "event_id")).alias("last")
    return events.groupBy(key).agg(last).select(key, "last.*")


def run_to_table(result: DataFrame, scratch: Scratch, name: str, mode: str = "append") -> DataFrame:
    """Process what is there, then return the table: appended as files, or for complete results the last one."""
    path = f"{scratch.root}/{name}"
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return scratch.spark.read.schema(result.schema).parquet(path)
