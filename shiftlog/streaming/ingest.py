"""Exports arriving in a folder -> the same cleaning chain -> processed log.

Structured Streaming watches the folder for new files; each micro-batch names
the files that arrived (their content is not read by the stream), which are
then read by the batch scan -- every file by its own header, quoted fields with
line breaks and all -- cleaned with the batch chain and appended to the
processed dataset.  Session-relative times need every row of a session, so an
export must hold whole sessions; a trigger takes whole files.  Each batch is
written to its own ``batch-N`` folder with overwrite, so a batch replayed after
a failure replaces its own output (exactly-once on the file sink together with
the checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shiftlog.plans.cleaning import CleaningConfig, Export, clean_log
from shiftlog.sources.readers import read_activity_log

#: The file source's own columns.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch_files(spark: SparkSession, folder: str,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the paths of new files."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder).select("path")


def batch_path(out_path: str, batch_id: int) -> str:
    return f"{out_path.rstrip('/')}/batch-{batch_id:09d}"


def read_ingested(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(f"{out_path.rstrip('/')}/batch-*")


def start_ingest(spark: SparkSession, folder: str, cfg: CleaningConfig, out_path: str,
                 checkpoint: str, lookups=None, available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the ingest; ``available_now`` processes what is there and stops
    (a scheduled job), otherwise it keeps watching the folder."""
    stream = watch_files(spark, folder, max_files_per_trigger)

    def clean_batch(batch: DataFrame, batch_id: int) -> None:
        # the names of one trigger's files, as the file source lists them
        paths = sorted(r["path"] for r in batch.collect())
        if not paths:
            return
        # (batch_id, activity_id) identifies a row; activity_id keeps file
        # order inside the batch and is the same when the batch is replayed
        rows = read_activity_log(batch.sparkSession, paths, cfg.form)
        cleaned = clean_log([Export(rows)], cfg, lookups)
        (cleaned.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").parquet(batch_path(out_path, batch_id)))

    w = stream.writeStream.foreachBatch(clean_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
