"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnkit.llm import mixing, near_dedup, orc_tokens, packing, pivot_topk, quality_rules, ring_sharding, substring_dedup, token_counts, tokens, warc_audit
from cairnkit.llm._util import cut, remove, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, group_id) of every document with a near duplicate."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed order of all documents' blocks of the tokenizer's tokens."""
    return mixing.plan(token_counts.token_counts(_table(spark, sf_dir, "documents"), keep=["source"]), tokens_col="n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens) of every document."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op4_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit finds between the records of all pages and those of a damaged replica."""
    pages = _table(spark, sf_dir, "pages")
    return warc_audit.audit(warc_audit.leaves(pages), warc_audit.leaves(warc_audit.damaged(pages)))


def warc_file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_warc_merkle over WARC files: both replicas written to the shared folder, read back and audited."""
    pages = _table(spark, sf_dir, "pages")
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    where = folder if ":" in folder else f"file://{folder}"
    found = []
    for name, replica in (("a", pages), ("b", warc_audit.damaged(pages))):
        warc_audit.write_warc(replica, f"{where}/{name}", packed=False)
        found.append(warc_audit.stored_leaves(warc_audit.read_warc(spark, f"{where}/{name}/*.warc")))
    differing = cut(warc_audit.audit(*found))
    remove(spark, folder)
    return differing


def _judged(spark: SparkSession, sf_dir: str) -> str:
    """The folder where the ledger of every document is stored, and the ablation of each policy over it; words are flagged by the labels."""
    docs = _table(spark, sf_dir, "documents")
    path = f"{shared_folder(spark)}/quality-{uuid.uuid4().hex}"
    quality_rules.write(docs, f"{path}/ledger", quality_rules.flagged_words(docs, _table(spark, sf_dir, "labels")))
    quality_rules.ablations(quality_rules.read(spark, f"{path}/ledger")).write.parquet(f"{path}/ablation")
    return path


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger of every document with each policy's decision; the policies' ablations are stored beside it."""
    return quality_rules.decide(quality_rules.read(spark, f"{_judged(spark, sf_dir)}/ledger"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5_quality_rules stores beside its ledger: what each rule does in each policy."""
    return spark.read.parquet(f"{_judged(spark, sf_dir)}/ablation")


def op6_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return ring_sharding.assign(_table(spark, sf_dir, "documents"))


def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all embeddings to every one whose id is divisible by 50, distances to six places."""
    return pivot_topk.top_k(_table(spark, sf_dir, "embeddings")).withColumn("distance", F.round("distance", 6))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of every document that repeats an earlier paragraph or passage."""
    return substring_dedup.repeats(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the packed sequences, lengths in the tokenizer's tokens."""
    return packing.pack(token_counts.token_counts(_table(spark, sf_dir, "documents")), tokens_col="n_tokens")


def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document, written to ORC in the shared folder and read back."""
    path = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    orc_tokens.write(_table(spark, sf_dir, "documents"), path)
    return orc_tokens.read(spark, path)


QUERIES = {"op1_minhash_dedup": op1_minhash_dedup, "op2_mixing": op2_mixing, "op3_token_counts": op3_token_counts, "op4_warc_merkle": op4_warc_merkle, "warc_file_audit": warc_file_audit, "op5_quality_rules": op5_quality_rules, "quality_ablation": quality_ablation, "op6_ring_sharding": op6_ring_sharding, "op7_pivot_topk": op7_pivot_topk, "op8_substring_dedup": op8_substring_dedup, "op9_packing": op9_packing, "op10_orc_tokens": op10_orc_tokens}
ORACLES: dict[str, str] = {
    "op2_mixing": mixing.plan_sql(tokens.counted_sql()),
    "op3_token_counts": f"WITH RECURSIVE {tokens.counted_sql()} SELECT doc_id, n AS n_tokens FROM counted",
    "op4_warc_merkle": warc_audit.audit_sql(),
    "warc_file_audit": warc_audit.audit_sql(),
    "op5_quality_rules": quality_rules.ledger_sql(),
    "quality_ablation": quality_rules.ablation_sql(),
    "op7_pivot_topk": pivot_topk.top_k_sql(),
    "op10_orc_tokens": tokens.ids_sql(),
}
