"""Sinks: the processed log and report bundles (one dataset per sheet)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from shiftlog.sources.readers import to_export


def write_processed(df: DataFrame, path: str, fmt: str = "parquet",
                    partition_by: Sequence[str] = ("session_date",),
                    mode: str = "overwrite") -> str:
    """Write the cleaned log.  Parquet partitioned by ``session_date`` so a
    date filter prunes files; ``fmt="csv"`` writes a header CSV.

    Rows are brought together by date first, else every task would write a
    file for every date; the adaptive plan splits a date that holds much."""
    parts = [p for p in partition_by if p in df.columns]
    if parts:
        df = df.hint("rebalance", *parts)
    w = df.write.mode(mode)
    if parts:
        w = w.partitionBy(*parts)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_export(df: DataFrame, form: str, path: str) -> str:
    """Write canonical rows as CSV exports of a form (the inverse of
    :func:`shiftlog.sources.readers.read_activity_log`), quotes doubled."""
    (to_export(df, form).write.mode("overwrite").option("header", True)
     .option("quote", '"').option("escape", '"').csv(path))
    return path


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write a typed scan once as parquet and continue from the written copy.

    The cleaning plan reads its input in several branches (main rows,
    per-session counts, session origins); from CSV each branch would parse
    every column again, from parquet each reads only its columns.  The copy
    in shared storage also cuts the lineage: a lost executor re-reads
    parquet instead of re-parsing exports.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_report(bundle: Mapping[str, DataFrame], base_path: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> dict[str, str]:
    """Write each named report table to ``{base_path}/{name}``.

    The reference writes one workbook with a sheet per table; a dataset per
    table keeps every write distributed.  Returns name -> path.
    """
    out = {}
    for name, df in bundle.items():
        path = f"{base_path.rstrip('/')}/{name}"
        w = df.write.mode(mode)
        if fmt == "csv":
            w.option("header", True).csv(path)
        else:
            w.format(fmt).save(path)
        out[name] = path
    return out


def read_report(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> dict[str, DataFrame]:
    return {n: spark.read.format(fmt).load(p) for n, p in paths.items()}


CATALOG_SCHEMA = StructType([StructField("sheet_name", StringType(), False),
                             StructField("description", StringType(), True)])


def report_catalog(spark: SparkSession, entries: Sequence[tuple[str, str]]) -> DataFrame:
    """Literal ``(sheet_name, description)`` table listing a bundle."""
    return spark.createDataFrame(list(entries), CATALOG_SCHEMA)
