"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and
returns a DataFrame, which run() writes as Parquet to the shared folder and reads again for
the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cairnkit.llm import mixing, near_dedup, packing, quality_rules, substring_dedup, token_counts
from cairnkit.llm._util import exists, remove, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the current rule policy doesn't reject; null and blank texts go.

    Words are flagged as toxic by the labels table of sf_dir; without one none are. Null ids
    and repeated rows are judged by their texts; an empty table stays empty.
    """
    path = f"{sf_dir}/labels.parquet"
    flagged = quality_rules.flagged_words(docs, spark.read.parquet(path)) if exists(spark, path) else []
    return quality_rules.keep(docs, flagged=flagged)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each near-duplicate group, and all documents in no group.

    Rows that repeat a doc_id are cut to one; rows with a null doc_id, a null text or no words
    stay. An empty table stays empty.
    """
    return near_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without what repeats an earlier paragraph or passage; those left empty go.

    Rows without spans, with null ids or texts come back as they were. An empty table stays empty.
    """
    return substring_dedup.strip(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the target proportions of their sources by tokens, repeated where a source needs it.

    Null sources are one source; rows without tokens (null or empty texts) come once. Rows
    that share a doc_id and source come equally often. An empty table stays empty.
    """
    return mixing.mix(docs, token_counts.token_counts(docs, keep=["source"]), tokens_col="n_tokens")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed training sequences: where each piece of each document lies in them, and its token ids.

    Null and empty texts have no piece; null ids and repeated rows are documents of their own.
    An empty table gives no rows.
    """
    return packing.pack_ids(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", source_mix),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents table of sf_dir; earlier stages' tables are removed once read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(path)
    return docs


#: Signatures, components and best-fit packing have no SQL; the tests hold each stage against a brute-force one.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
