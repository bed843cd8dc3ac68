"""One registered query per operator; each applies it to its whole table."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlog.llm import (bpe_words, conversations, ego_join, filter_audit, fingerprints,
                          jaccard_join, licenses, packing, pii, quality, sharding, token_counts,
                          toxicity)
from shiftlog.llm.common import stored, table


RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits made from
    its own text: the middle is replaced by the beginning, the end is put in
    at a quarter, and a passage at three quarters is deleted."""
    path = public_tokenizers.path(RANKS)
    docs = token_counts.build_trees(
        table(spark, sf_dir, "documents").select("doc_id", "text"), path,
        public_tokenizers.PATTERN)
    n = F.char_length("text")
    edits = F.array(*(
        F.struct(F.floor(n * at).cast("int").alias("start"), F.lit(length).alias("length"),
                 insert.alias("insert"))
        for at, length, insert in ((0.5, 24, F.substring("text", 1, 20)),
                                   (0.25, 0, F.substring("text", -16, 16)),
                                   (0.75, 12, F.lit(None).cast("string")))))
    done = token_counts.apply_edits(docs.withColumn("edits", edits), path,
                                    public_tokenizers.PATTERN)
    return done.select("doc_id", token_counts.n_tokens("tree").cast("long").alias("n_tokens"),
                       token_counts.n_tokens("edited_tree").cast("long").alias("n_tokens_edited"),
                       F.char_length("edited_text").cast("long").alias("n_chars_edited"),
                       "n_reencoded")


def op2_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    encoded = bpe_words.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN,
                               decoded=True)
    return encoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards whose bytes are near equal; ``slot`` is the row's place in
    its shard and ``virtual_slot`` the slot it hashes to."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("place").cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
                         "map_version")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    n = F.when(F.col("sentence_ids")[0] == "", 0).otherwise(F.size("sentence_ids"))
    return found.select("doc_id", n.cast("long").alias("n_sentences"),
                        F.concat_ws(",", "licenses").alias("licenses"), "kind")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.train(docs))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        own = F.filter("spans", lambda s: s["base"] & (s["kind"] == F.lit(kind)))
        return F.size(own).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts,
                        F.sha2(pii.spans_text(base), 256).alias("base_sha256"),
                        pii.spans_text(F.col("spans")).alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.json"), digest=zlib.crc32)
    return placed.select("doc_id", "piece", "start", "length", F.col("ids_digest").alias("ids_crc32"),
                         "sequence_id", "offset")


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fingerprints.edited_neighbours(table(spark, sf_dir, "documents"))
    mine = F.col("sketch")
    return done.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(mine).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(mine, F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(mine, F.col("next_sketch")).alias("near_next"),
        fingerprints.distinct_shingles(mine).alias("n_shingles"))


def op10_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.summaries(stored(conversations.repair(rows), "repaired"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flagged``: whether the score reaches its language's threshold."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "lang", "text"), model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        toxicity.flagged(model).alias("flagged"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_words": op2_bpe_words,
    "op3_virtual_slots": op3_virtual_slots,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_license_scan": op5_license_scan,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_bottom_k": op9_bottom_k,
    "op10_ego_join": op10_ego_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL = {
    "op4_jaccard_join": jaccard_join.components_sql(),
    "op5_license_scan": licenses.scan_sql(),
    "op11_conversation_repair": conversations.repair_sql(),
    "op12_filter_audit": filter_audit.audit_sql(),
}
