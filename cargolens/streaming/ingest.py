"""Structured Streaming jobs: ingestion of pending documents, audit events without repeats, live progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.normalize import event_hash
from ..sources.store import kept
from ..sources.stored import StoredTable


def _arriving(spark: SparkSession, source: str, schema: StructType, files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)


def ingest(
    spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame],
    good: Column | None = None, dead: Callable[[DataFrame], DataFrame] | None = None, files: int | None = None,
) -> None:
    """Process each new file of ``source`` once and append the results; the checkpoint makes a restart go on where it stopped.

    ``good``: rows that can be processed. The others go through ``dead`` instead, to rows beside the results under
    ``{out}/dead``, and the rest of their batch goes on. ``files``: at most so many files a batch.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch
        if good is not None:  # each way reads the batch's files, which costs less than to write the batch again
            told = batch.withColumn("__good", F.coalesce(good, F.lit(False)))
            rows = told.filter("__good").drop("__good")
            dead(told.filter("NOT __good").drop("__good")).write.mode("overwrite").parquet(f"{out}/dead/epoch={epoch}")
        process(rows).write.mode("overwrite").parquet(f"{out}/done/epoch={epoch}" if good is not None else f"{out}/epoch={epoch}")  # a repeated epoch replaces itself

    _arriving(spark, source, schema, files).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def audit_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events (ts, module, action, outcome) with their hash, each hash once within the watermark."""
    hashed = events.withColumn("event_hash", event_hash(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("module"), F.col("action"), F.col("outcome")))
    return hashed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_hash"])


def progress(documents: DataFrame) -> DataFrame:
    """dossier_id, n_documents, n_done, n_error: counts of documents by their status."""
    return documents.groupBy("dossier_id").agg(F.count("*").alias("n_documents"), F.count_if(F.col("status") == "done").alias("n_done"), F.count_if(F.col("status") == "error").alias("n_error"))


DOCUMENTS = "dossier_id long, document_id string, status string, at timestamp"
PROGRESS = "dossier_id long, n_documents long, n_done long, n_error long, at timestamp"


def progress_tables(spark: SparkSession, out: str, buckets: int = 32) -> tuple[StoredTable, StoredTable]:
    """(documents with their last status, progress by dossier), both dealt by dossier."""
    documents = StoredTable(spark, f"{out}/documents", DOCUMENTS, ("dossier_id", "document_id"), ("dossier_id",), buckets)
    return documents, StoredTable(spark, f"{out}/progress", PROGRESS, ("dossier_id",), (), buckets)


def live_progress(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, events: Callable[[DataFrame], DataFrame], files: int | None = None, buckets: int = 32) -> None:
    """Keep the progress of dossiers up to date from arriving status events.

    ``events`` makes dossier_id, document_id, status, at of the arriving rows. The stream's state is the last status of
    each document, so its keys are as many as the documents and none is hot. In update mode a batch brings the documents
    that changed; they are upserted, and the counts of their dossiers are made anew from the stored statuses and
    upserted. Both writes are by key, so repeated batches and repeated files change nothing.
    """
    last = events(_arriving(spark, source, schema, files)).groupBy("dossier_id", "document_id").agg(F.max(F.struct("at", "status")).alias("x"))

    def write(batch: DataFrame, epoch: int) -> None:
        documents, counts = (StoredTable(batch.sparkSession, t.path, t.schema, t.keys, t.bucket_by, t.buckets) for t in progress_tables(spark, out, buckets))
        changed = kept(batch.select("dossier_id", "document_id", "x.status", "x.at"), "changed")
        documents.upsert(changed, ["at", "status"])
        dossiers = changed.select("dossier_id").distinct()
        now = documents.read(dossiers).join(dossiers, "dossier_id", "left_semi")
        counts.change(progress(now).join(now.groupBy("dossier_id").agg(F.max("at").alias("at")), "dossier_id"), lambda old, new: old.join(new, "dossier_id", "left_anti").unionByName(new))

    last.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
