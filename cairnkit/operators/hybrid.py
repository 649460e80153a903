"""Reciprocal-rank fusion of two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
FETCH = 5


def fuse(dense: DataFrame, sparse: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score, dense_rank, sparse_rank, rank) of rankings (query_id, chunk_id, rank).

    A chunk scores 1 / (rrf_k + rank) in each ranking that holds it. Equal scores go by dense
    rank, those without one last, and then by sparse rank.
    """
    d = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "chunk_id", F.col("rank").alias("sparse_rank"))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer")

    def share(rank: str):
        return F.coalesce(1.0 / (F.col(rank) + rrf_k), F.lit(0.0))

    scored = both.withColumn("score", share("dense_rank") + share("sparse_rank"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= max(0, k))
