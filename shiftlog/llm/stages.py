"""Stages of the pipeline: each applies one operator and its decisions.

A stage works on all rows of ``docs`` and keeps their columns, whatever else
these hold; rows with null text pass the filters unless their score says
otherwise.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlog.llm import jaccard_join, packing, pii, quality
from shiftlog.llm.common import ship, stored, table


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    return name


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression score reaches the threshold stay."""
    ship(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = _free(docs, "score")
    return (quality.score(docs, model, score).where(F.col(score) >= quality.THRESHOLD)
            .select(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the
    smallest id; of repeated rows, one.  A null id is replaced, for this
    stage, by one that the text decides, below all others."""
    ship(spark)
    key, digest = _free(docs, "key"), _free(docs, "digest")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 62)
                                            - F.pmod(F.xxhash64(text), F.lit(2 ** 61))))
    groups = jaccard_join.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"))
    kept = stored(groups.where(F.col("doc_id") == F.col("component_id"))
                  .select(F.col("doc_id").alias(key)).distinct(), "kept")
    return (keyed.join(kept, key, "left_semi").withColumn(digest, F.xxhash64(text))
            .dropDuplicates([key, digest]).select(docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans become their kind in angle brackets; n_chars follows."""
    ship(spark)
    spans = _free(docs, "spans")
    out = pii.redact(pii.detect(docs, pii.train(docs), spans), spans)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left; the last stage, so it returns pieces
    with their ids and places."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
