"""The registered queries: each reads its whole table and returns the full result of one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, fim, fingerprints, innerproducts, lm, mixing, neardup, packing, resampling, secrets, sharding, toxicity, warc
from .common import new_path, table


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_size", "mates_before", "mates_after")


def op5_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def toxicity_held_out():
    """Rows whose labels are never learnt."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity_held_out())
    return toxicity.score_documents(docs, network, toxicity_held_out())


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan_corpus(table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(mixing.sized(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long"), "target", "taken")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of match: exact phrases in the columns of the contract, proximity in n_near and near_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = decontamination.Index(docs, table(spark, sf_dir, "benchmark"))
    return decontamination.whole_report(decontamination.phrase_matches(docs, index), decontamination.proximity_matches(index))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_innerproducts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return innerproducts.top_k(table(spark, sf_dir, "embeddings"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(fim.form_documents(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_syncmers, op2_packing, op3_warc, op4_sharding, op5_backoff, op6_toxicity, op7_secrets, op8_mixing, op9_decontamination, op10_neardup, op11_resampling, op12_innerproducts, op13_fim)}
ORACLES = {"op3_warc": warc.ORACLE, "op5_backoff": lm.ORACLE, "op7_secrets": secrets.ORACLE, "op8_mixing": mixing.ORACLE, "op9_decontamination": decontamination.ORACLE, "op10_neardup": neardup.ORACLE, "op11_resampling": resampling.ORACLE, "op12_innerproducts": innerproducts.ORACLE, "op13_fim": fim.ORACLE}
