"""The shared tables seen as the engine's: documents as chunks, embeddings as vectors, benchmark as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnkit.schema import ZONES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zone(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ZONES)), (F.pmod(number, F.lit(3)) + 1).cast("int"))


def record_type(number: Column) -> Column:
    return F.when(F.pmod(number, F.lit(10)) == 0, "baseline").otherwise("knowledge")


def source_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as in-memory files: (source_path, text, language, doc_no)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"), "text", F.col("lang").alias("language"), F.col("doc_id").alias("doc_no"))


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as one chunk each: (chunk_id, zone_id, record_type, text, filename, language, doc_no)."""
    docs = source_docs(spark, sf_dir)
    return docs.select(F.sha1("source_path").alias("chunk_id"), zone(F.col("doc_no")).alias("zone_id"), record_type(F.col("doc_no")).alias("record_type"), "text", F.concat(F.col("doc_no").cast("string"), F.lit(".txt")).alias("filename"), "language", "doc_no")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with a zone by label and a record type by id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", "label", zone(F.col("label")).alias("zone_id"), record_type(F.col("vec_id")).alias("record_type"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as (query_id, zone_id, query)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), zone(F.col("item_id")).alias("zone_id"), F.col("text").alias("query"))
