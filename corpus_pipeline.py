"""The training-data pipeline: documents through four operators, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftlog.llm import stages
from shiftlog.llm.common import stored, table

#: name, function (spark, docs, sf_dir) -> DataFrame.  Each stage works on all
#: rows its predecessor kept; all but the last return the columns of documents.
STAGES = [
    ("filter_quality", stages.filter_quality),
    ("drop_near_duplicates", stages.drop_near_duplicates),
    ("redact_personal_data", stages.redact_personal_data),
    ("pack_sequences", stages.pack_sequences),
]

#: Tokenising, model scores and planned packing have no SQL form; the stages
#: are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through every stage, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
