"""Views of an append-only change log, kept current with Structured Streaming.

The change log is a folder of Parquet files that only grows. A file-source stream reads new
files as they land, in whatever order. Two tails follow it:

* ``tail_status`` writes each micro-batch's status lines;
* ``tail_newest`` keeps the newest entry of each branch and object: a stateful aggregate (one row of state per object, whatever the log's
  length) in update mode, so a micro-batch hands on only the objects that it changed. An entry is newer by its id, not by when its file
  came, so late files change nothing that is newer already.

Both write under ``epoch=<id>`` and overwrite that epoch on a replay, so a query that is restarted from its checkpoint never
duplicates anything. The checkpoint folder names the query's progress: it must be given, under storage that all executors share.
``read_newest`` merges the epochs; ``compact_newest`` writes them as one. No watermark is needed: there is no event-time aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changelog import LOG_SCHEMA

NEWEST_SCHEMA = "branch string, object_identity string, id long, event_time timestamp, command_tag string, command string"


def status_frame(entries: DataFrame) -> DataFrame:
    """``tag type identity`` per log entry (NULL parts read as '')."""
    return entries.select("branch", "id", F.concat_ws(" ", F.coalesce("command_tag", F.lit("")),
                                                      F.coalesce("object_type", F.lit("")),
                                                      F.coalesce("object_identity", F.lit(""))).alias("line"))


def _entries(spark: SparkSession, log_path: str, branch: str | None, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(LOG_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(log_path)
    return stream if branch is None else stream.filter(F.col("branch") == branch)


def _start(stream: DataFrame, out_path: str, checkpoint: str, mode: str, available_now: bool) -> StreamingQuery:
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")

    w = stream.writeStream.outputMode(mode).foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def tail_status(spark: SparkSession, log_path: str, out_path: str, checkpoint: str, branch: str | None = None,
                available_now: bool = True, files_per_batch: int | None = None) -> StreamingQuery:
    """Start the tail; with ``available_now`` it processes what is there and stops."""
    return _start(status_frame(_entries(spark, log_path, branch, files_per_batch)), out_path, checkpoint, "append", available_now)


def newest(entries: DataFrame) -> DataFrame:
    """The newest entry (largest id) of each branch and object; entries without an identity are left out."""
    best = F.max_by(F.struct("event_time", "command_tag", "command"), "id").alias("e")
    found = entries.where("object_identity is not null and id is not null").groupBy("branch", "object_identity").agg(F.max("id").alias("id"), best)
    return found.select("branch", "object_identity", "id", "e.*")


def tail_newest(spark: SparkSession, log_path: str, out_path: str, checkpoint: str, branch: str | None = None,
                available_now: bool = True, files_per_batch: int | None = None) -> StreamingQuery:
    """Start the tail of the newest entries; read them by ``read_newest``."""
    return _start(newest(_entries(spark, log_path, branch, files_per_batch)), out_path, checkpoint, "update", available_now)


def read_newest(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest entry of each branch and object, from all epochs: an older epoch's row is never newer, whatever was replayed."""
    return newest(spark.read.schema(NEWEST_SCHEMA).parquet(out_path))


def compact_newest(spark: SparkSession, out_path: str, to: str) -> DataFrame:
    """The merged epochs, written to a fresh folder as its first epoch."""
    read_newest(spark, out_path).write.mode("errorifexists").parquet(f"{to}/epoch=-1")
    return read_newest(spark, to)
