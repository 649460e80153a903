"""The retrieval service: one store, dense, keyword and hybrid search over it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnkit.operators import dense, hybrid, sparse
from cairnkit.plans.store import ChunkStore, metadata
from cairnkit.schema import HIT, DeleteResult, UpsertResult, assert_zone

SPARSE_MODES = ("okapi", "fts5")


class RetrievalService:
    """All verbs over the chunk store. Keyword indexes belong to a snapshot of the same table, so never out of step."""

    def __init__(self, store: ChunkStore, sparse_mode: str = "okapi", rrf_k: int = hybrid.RRF_K, index_deleted: bool = True):
        if sparse_mode not in SPARSE_MODES:
            raise ValueError(f"sparse_mode must be one of {', '.join(SPARSE_MODES)}")
        self.store, self.sparse_mode, self.rrf_k, self.index_deleted = store, sparse_mode, rrf_k, index_deleted

    def ensure_zone(self, zone_id: str, dim: int) -> None:
        self.store.ensure_zone(zone_id, dim)

    def upsert(self, zone_id: str, records: DataFrame) -> UpsertResult:
        return self.store.upsert(zone_id, records)

    def _empty(self) -> DataFrame:
        return self.store.spark.createDataFrame([], HIT)

    def _hits(self, rows: DataFrame) -> DataFrame:
        return rows.select("chunk_id", "doc_id", "zone_id", F.col("score").cast("double").alias("score"), "text", metadata().alias("metadata"), F.col("rank").cast("int").alias("rank")).orderBy("rank")

    def search(self, zone_id: str, query_vec: list[float], top_k: int = 10, filters: dict[str, Any] | None = None, overfetch: int | None = None) -> DataFrame:
        """The best chunks by vector; the query must have the store's dimension."""
        assert_zone(zone_id)
        if top_k <= 0:
            return self._empty()
        if len(query_vec) != self.store.dim:
            raise ValueError(f"the query has {len(query_vec)} places, the store {self.store.dim}")
        return self._hits(dense.top_k(self.store.chunks(zone_id), query_vec, top_k, filters, self.store.distance, overfetch=overfetch))

    def _sparse(self, zone_id: str, query: str, k: int, filters: dict[str, Any] | None) -> DataFrame:
        live = self.store.chunks(zone_id)
        allowed = live.where(dense.predicate(dense.normalize_filters(filters)))
        asked = self.store.spark.createDataFrame([(0, zone_id, query)], "query_id int, zone_id string, query string")
        if self.sparse_mode == "okapi":
            return sparse.okapi_top(self.store.index(zone_id), asked, k, allowed)
        zones = [z for z, v in self.store.zones().items() if v["snapshot"]]
        indexed = self.store.index(zone_id, "fts5", self.index_deleted)
        for other in zones:
            if other != zone_id:
                indexed = indexed.unionByName(self.store.index(other, "fts5", self.index_deleted))
        return sparse.rank(sparse.fulltext_hits(indexed, asked, allowed), k)

    def sparse_search(self, zone_id: str, query: str, top_k: int = 10, filters: dict[str, Any] | None = None) -> DataFrame:
        """The best chunks by keywords; a query without tokens gives none."""
        assert_zone(zone_id)
        if top_k <= 0 or not query.strip():
            return self._empty()
        found = self._sparse(zone_id, query, top_k, filters).select("chunk_id", "score", "rank")
        return self._hits(self.store.chunks(zone_id).join(F.broadcast(found), "chunk_id"))

    def hybrid_search(self, zone_id: str, query: str, query_vec: list[float], top_k: int = 10, filters: dict[str, Any] | None = None) -> DataFrame:
        """Both rankings, five times as deep, fused by reciprocal ranks."""
        assert_zone(zone_id)
        if top_k <= 0:
            return self._empty()
        if len(query_vec) != self.store.dim:
            raise ValueError(f"the query has {len(query_vec)} places, the store {self.store.dim}")
        deep = top_k * hybrid.FETCH
        one = dense.top_k(self.store.chunks(zone_id), query_vec, deep, filters, self.store.distance).select(F.lit(0).alias("query_id"), "chunk_id", "rank")
        two = self._sparse(zone_id, query, deep, filters).select("query_id", "chunk_id", "rank") if query.strip() else one.limit(0)
        found = hybrid.fuse(one, two, top_k, self.rrf_k).select("chunk_id", "score", "rank")
        return self._hits(self.store.chunks(zone_id).join(F.broadcast(found), "chunk_id"))

    def delete(self, zone_id: str, chunk_ids: list[str]) -> DeleteResult:
        return self.store.delete(zone_id, chunk_ids)

    def delete_by_doc_id(self, zone_id: str, doc_id: str) -> DeleteResult:
        return self.store.delete_by_doc_id(zone_id, doc_id)

    def get_baseline(self, zone_id: str) -> DataFrame:
        return self.store.baseline(zone_id)

    def export_zone(self, zone_id: str, target_dir: str, form: str = "parquet") -> dict:
        return self.store.export_zone(zone_id, target_dir, form)


def build_service(spark: SparkSession, root: str, mode: str = "online", dim: int = 384, distance: str = "cosine", model: str = "") -> RetrievalService:
    """`online`: per-zone Okapi statistics; `offline`: full-text statistics over the whole store."""
    if mode not in ("online", "offline"):
        raise ValueError("mode must be online or offline")
    return RetrievalService(ChunkStore(spark, root, dim, distance, model), "okapi" if mode == "online" else "fts5")
