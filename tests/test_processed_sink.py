"""Files of the processed log, which is partitioned by date."""

from pathlib import Path

from pyspark.sql import functions as F

from shiftlog.sources.sinks import write_processed


def _files(spark, path):
    rows = spark.read.parquet(path).groupBy("session_date", F.input_file_name().alias("file")).count()
    return [(str(r["session_date"]), Path(r["file"]).name) for r in rows.collect()]


def _log(spark, date):
    return spark.range(0, 4000, 1, 8).select(
        F.col("id").alias("activity_id"), date.alias("session_date"),
        F.sha2(F.col("id").cast("string"), 512).alias("comments"))


def test_tasks_do_not_write_a_file_for_every_date(spark, tmp_path):
    """Eight tasks with rows of ten dates each: a file per date, not 80."""
    date = F.when(F.col("id") % 10 > 0, F.format_string("2024-01-%02d", F.col("id") % 10))
    log = _log(spark, date)
    path = write_processed(log, str(tmp_path / "processed"))
    assert len(_files(spark, path)) == 10
    back = spark.read.schema(log.schema).parquet(path).select(*log.columns)
    assert back.exceptAll(log).isEmpty() and back.count() == 4000


def test_a_date_that_holds_most_rows_is_written_by_several_tasks(spark, tmp_path):
    date = F.when(F.col("id") % 10 == 0, "2024-01-02").otherwise("2024-01-01")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "100k")
    try:
        path = write_processed(_log(spark, date), str(tmp_path / "processed"))
    finally:
        spark.conf.unset(size)
    files = _files(spark, path)
    assert sum(d == "2024-01-01" for d, _ in files) > 1
    assert spark.read.parquet(path).count() == 4000
