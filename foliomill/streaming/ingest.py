"""Streaming intake of documents: first copies pass, later ones are marked, and the run's status grows batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def read_documents(spark, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)


def first_copies(docs: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """Documents whose content didn't arrive within the delay before; state is one hash per content and ends with the watermark."""
    return docs.withWatermark(time, delay).withColumn("sha256", F.sha2("text", 256)).dropDuplicatesWithinWatermark(["sha256"])


def event_counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums per type and window of event time; late rows within the delay still count."""
    by = F.window("ts", window)
    return events.withWatermark("ts", delay).groupBy(by, "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "events", "value")


def convert_stream(docs: DataFrame, table: str, checkpoint: str, convert: Callable[[DataFrame], DataFrame], dpi: int = 300, version: str = "1") -> StreamingQuery:
    """Convert documents (doc_id, sha256, ...) as they arrive and keep a table of their status.

    convert: documents to (doc_id, status, error). A document that the table holds as finished with the same content, resolution and version is not
    converted again, though it arrives again. A batch that runs again after a failure replaces its own rows, so each document counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = entries(spark, table).where(F.col("batch") != number).where(F.col("status") == "success").where((F.col("dpi") == dpi) & (F.col("version") == version))
        new = batch.join(old.select("doc_id", "sha256"), ["doc_id", "sha256"], "left_anti")
        done = convert(new).join(new.select("doc_id", "sha256"), "doc_id").select("doc_id", "sha256", "status", "error")
        done.withColumns({"dpi": F.lit(dpi), "version": F.lit(version)}).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ENTRIES = "doc_id string, sha256 string, status string, error string, dpi int, version string, batch bigint"


def entries(spark: SparkSession, table: str) -> DataFrame:
    """The status table; empty before the first batch."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], ENTRIES)
    return spark.read.schema(ENTRIES).option("basePath", table).parquet(table)


def status(found: DataFrame, active: bool = False, interrupted: bool = False, pending: int = 0) -> DataFrame:
    """One row: counts of the entries and the state of the run: running, interrupted, completed, completed_with_limit or completed_with_failures."""
    d = found.agg(F.count("*").alias("processed_count"), F.count_if(F.col("status") == "success").alias("success_count"), F.count_if(F.col("status") == "duplicate").alias("duplicate_count"), F.count_if(F.col("status") == "failed").alias("failure_count"))
    ended = F.when(F.col("failure_count") > 0, "completed_with_failures").when(F.lit(pending) > 0, "completed_with_limit").otherwise("completed")
    return d.withColumns({"pending_count": F.lit(pending), "status": F.when(F.lit(interrupted), "interrupted").when(F.lit(active), "running").otherwise(ended)})


class Progress(StreamingQueryListener):
    """Tells a function of each batch: progress(message)."""

    def __init__(self, progress: Callable[[str], None]):
        self.progress = progress

    def onQueryStarted(self, event) -> None:
        self.progress(f"{event.name or event.id}: started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.progress(f"[{p.batchId}] {p.numInputRows} documents")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.progress(f"{event.id}: " + (f"failed, {event.exception}" if event.exception else "ended"))
