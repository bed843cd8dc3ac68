"""Helpers shared by the operators: tables, written intermediates, batches."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlog.session import scratch_dir


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python workers, once per
    application (what ``spark-submit --py-files`` would do)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(), "shiftlog_llm.zip")
    with zipfile.ZipFile(to, "w") as z:
        for f in [root / "__init__.py", root / "session.py", *sorted(root.glob("llm/*.py"))]:
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(to))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there,
    so a lost executor never recomputes what came before, and values that
    depend on the partitioning (task numbers, ranks) are fixed."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def rows_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def int_lists(values, offsets, kind=None) -> pa.ListArray:
    """Arrow list array over one flat numpy array."""
    flat = pa.array(values, kind or pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def extended(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of ``df`` with more columns, given as name=type."""
    more = [T.StructField(n, T._parse_datatype_string(k)) for n, k in kinds.items()]
    return T.StructType([*df.schema.fields, *more])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)],
                                      schema=schema)


def squeeze(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 by byte plane, which compresses well."""
    return squeeze(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()
