"""The chunk store: immutable snapshots of each zone behind a pointer."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnkit.functions.lineage import cut
from cairnkit.functions.text import chunk_key
from cairnkit.operators import sparse
from cairnkit.operators.encode import normalize
from cairnkit.schema import METADATA, RECORD, STORED, DeleteResult, UpsertResult, assert_zone, violations

SCHEMA_VERSION = 1


def latest(records: DataFrame, order: Column | None = None) -> DataFrame:
    """The last record of each chunk_id in a batch by `order`.

    Without an order the last in the order read, which is that of the rows in a DataFrame made
    of files or a list; after a shuffle there is none, and an order column should be given.
    """
    by = Window.partitionBy("zone_id", "chunk_id").orderBy(F.desc("_seq"))
    numbered = records.withColumn("_seq", F.monotonically_increasing_id() if order is None else order)
    return numbered.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank", "_seq")


def merge(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """old with new's records by (zone_id, chunk_id): all columns replaced, created_at kept, deletion undone."""
    born = old.select("zone_id", "chunk_id", F.col("created_at").alias("_born"))
    columns = [c.strip().split(" ")[0] for c in STORED.split(",")]
    added = new.join(born, ["zone_id", "chunk_id"], "left").withColumns({"is_deleted": F.lit(False), "created_at": F.coalesce("_born", now), "updated_at": now})
    kept = old.join(new.select("zone_id", "chunk_id"), ["zone_id", "chunk_id"], "left_anti")
    return kept.select(*columns).unionByName(added.select(*columns))


def soft_delete(chunks: DataFrame, gone: Column, now: Column) -> DataFrame:
    hit = gone & ~F.col("is_deleted")
    return chunks.withColumns({"updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "is_deleted": F.col("is_deleted") | hit})


def zone_counts(chunks: DataFrame) -> DataFrame:
    """(zone_id, record_count, baseline_count) of the live knowledge and baseline records of each zone."""
    live = ~F.col("is_deleted")
    return chunks.groupBy("zone_id").agg(F.count_if(live & (F.col("record_type") == "knowledge")).alias("record_count"), F.count_if(live & (F.col("record_type") == "baseline")).alias("baseline_count"))


def metadata() -> Column:
    return F.struct(*METADATA)


class ChunkStore:
    """Chunk records of all zones under one root.

    A zone is a folder of Parquet partitioned by record_type. Each change writes the zone's
    next snapshot and then moves the pointer, so that readers see whole snapshots and a job
    that dies changes nothing. One writer at a time. Only the zone that changes is rewritten.
    """

    def __init__(self, spark: SparkSession, root: str, dim: int = 384, distance: str = "cosine", model: str = "", chunk_options: dict | None = None):
        if distance not in ("cosine", "dot", "euclid"):
            raise ValueError("distance must be cosine, dot or euclid")
        self.spark, self.root, self.dim, self.distance, self.model = spark, root.rstrip("/"), dim, distance, model
        self.chunk_options = chunk_options or {"strategy": "hybrid", "max_tokens": 300, "overlap": 50}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read(self, name: str) -> dict:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        """Whole, or not at all: to a new name beside it, then renamed over it."""
        fs, p = self._fs(path)
        _, temp = self._fs(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) if p.toUri().getScheme() else self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temp, p, options)

    def zones(self) -> dict:
        """The registry: {zone_id: {embedding_dim, created_at, snapshot}}."""
        return self._read("zones.json")

    def ensure_zone(self, zone_id: str, dim: int | None = None) -> None:
        """Register the zone. Its dimension must be the store's."""
        assert_zone(zone_id)
        if (dim or self.dim) != self.dim:
            raise ValueError(f"the store holds vectors of {self.dim}, not of {dim}")
        found = self.zones()
        if zone_id not in found:
            found[zone_id] = {"embedding_dim": self.dim, "created_at": int(time.time()), "snapshot": None}
            self._write(f"{self.root}/zones.json", json.dumps(found))
        elif found[zone_id]["embedding_dim"] != self.dim:
            raise ValueError(f"zone {zone_id} holds vectors of {found[zone_id]['embedding_dim']}")

    def chunks(self, zone_id: str | None = None, deleted: bool = False) -> DataFrame:
        """The records of a zone, or of all zones; deleted ones only if asked for."""
        if zone_id is not None:
            assert_zone(zone_id)
        found = [(z, v["snapshot"]) for z, v in self.zones().items() if v["snapshot"] and zone_id in (None, z)]
        rows = self.spark.createDataFrame([], STORED)
        for k, (_, path) in enumerate(found):
            part = self.spark.read.schema(STORED).parquet(path)
            rows = part if k == 0 else rows.unionByName(part)
        return rows if deleted else rows.where(~F.col("is_deleted"))

    def index(self, zone_id: str, kind: str = "okapi", deleted: bool = False) -> DataFrame:
        """The keyword index of a zone's snapshot, `okapi` or `fts5`, written beside it at its first use.

        A snapshot never changes, so neither does its index; a change of the zone makes a new
        snapshot. Postings lie in the order of their terms, so that a search reads few of them.
        """
        terms = {"okapi": sparse.okapi_terms, "fts5": sparse.fulltext_terms}[kind]
        snapshot = self.zones().get(zone_id, {}).get("snapshot")
        if not snapshot:
            return sparse.index(terms(self.chunks(zone_id, deleted)))
        path = f"{snapshot}-{kind}{'-all' * deleted}"
        fs, p = self._fs(f"{path}/_SUCCESS")
        if not fs.exists(p):
            made = sparse.index(terms(self.chunks(zone_id, deleted)))
            made.repartitionByRange("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _commit(self, zone_id: str, rows: DataFrame) -> None:
        path = f"{self.root}/{zone_id}/{uuid.uuid4().hex}"
        rows.sortWithinPartitions("record_type", "doc_id", "chunk_index").write.partitionBy("record_type").parquet(path)
        found = self.zones()
        found[zone_id]["snapshot"] = path
        self._write(f"{self.root}/zones.json", json.dumps(found))

    def vacuum(self) -> int:
        """Remove the snapshots that no pointer names, once no reader uses them; how many there were."""
        used = {v["snapshot"].rsplit("/", 1)[-1] for v in self.zones().values() if v["snapshot"]}
        removed = 0
        for zone in self.zones():
            fs, p = self._fs(f"{self.root}/{zone}")
            if fs.exists(p):
                for status in fs.listStatus(p):
                    if status.getPath().getName().split("-")[0] not in used:
                        fs.delete(status.getPath(), True)
                        removed += 1
        return removed

    def upsert(self, zone_id: str, records: DataFrame, now: int | None = None) -> UpsertResult:
        """Add records or replace those of the same chunk_id; the last of a batch wins.

        Everything is checked before anything is written. A null or empty chunk_id is made
        from document, place and content. Vectors are made unit length for cosine distance.
        """
        self.ensure_zone(zone_id)
        names = [c.strip().split(" ")[0] for c in RECORD.split(",")]
        made = F.when(F.coalesce("chunk_id", F.lit("")) == "", chunk_key(F.col("doc_id"), F.col("chunk_index"), F.col("content_hash"))).otherwise(F.col("chunk_id"))
        ready = cut(records.select(*names).withColumn("chunk_id", made))  # cleaned, chunked and encoded once
        attempted = ready.count()
        if not attempted:
            return UpsertResult(0, 0)
        if broken := violations(ready, zone_id, self.dim):
            raise ValueError("; ".join(f"{n} records: {k}" for k, n in broken.items()))
        if self.distance == "cosine":
            ready = ready.withColumn("vector", normalize(F.col("vector")).cast("array<float>"))
        new, old = latest(ready), self.chunks(zone_id, deleted=True)
        updated = old.join(new.select("chunk_id").distinct(), "chunk_id", "left_semi").count()
        self._commit(zone_id, merge(old, new, F.lit(int(time.time()) if now is None else now).cast("bigint")))
        return UpsertResult(attempted, attempted, updated)

    def delete(self, zone_id: str, chunk_ids: list[str], now: int | None = None) -> DeleteResult:
        """Mark chunks as deleted; counts those that were live."""
        assert_zone(zone_id)
        if not chunk_ids:
            return DeleteResult(0, 0)
        return self._delete(zone_id, F.col("chunk_id").isin(list(chunk_ids)), len(chunk_ids), now)

    def delete_by_doc_id(self, zone_id: str, doc_id: str, now: int | None = None) -> DeleteResult:
        """Mark all live chunks of a document as deleted, of both record types."""
        assert_zone(zone_id)
        return self._delete(zone_id, F.col("doc_id") == doc_id, None, now) if doc_id else DeleteResult(0, 0)

    def _delete(self, zone_id: str, gone: Column, requested: int | None, now: int | None) -> DeleteResult:
        ids = [r.chunk_id for r in self.chunks(zone_id).where(gone).select("chunk_id", "doc_id", "chunk_index").orderBy("doc_id", "chunk_index", "chunk_id").collect()]
        if ids:
            stamp = F.lit(int(time.time()) if now is None else now).cast("bigint")
            self._commit(zone_id, soft_delete(self.chunks(zone_id, deleted=True), gone, stamp))
        return DeleteResult(len(ids) if requested is None else requested, len(ids), ids)

    def counts(self, zone_id: str) -> tuple[int, int]:
        found = zone_counts(self.chunks(zone_id)).where(F.col("zone_id") == zone_id).first()
        return (found.record_count, found.baseline_count) if found else (0, 0)

    def baseline(self, zone_id: str) -> DataFrame:
        """(chunk_id, doc_id, zone_id, the metadata, vector) of the live baseline, by document and place."""
        rows = self.chunks(zone_id).where("record_type = 'baseline'")
        return rows.select("chunk_id", "doc_id", "zone_id", *METADATA, "vector").orderBy("doc_id", "chunk_index")

    def export_zone(self, zone_id: str, target: str, form: str = "parquet") -> dict:
        """Write a zone's live records, its baseline, a manifest and checksums; returns the manifest.

        form is `parquet`, or `jsonl` for lines of id, vector and payload. The checksums are
        SHA-256 of every file written, worked out on the executors.
        """
        if form not in ("parquet", "jsonl"):
            raise ValueError("form must be parquet or jsonl")
        rows, folder = self.chunks(zone_id), f"{target.rstrip('/')}/{zone_id}"
        if form == "parquet":
            rows.write.mode("overwrite").parquet(f"{folder}/chunks")
            self.baseline(zone_id).write.mode("overwrite").parquet(f"{folder}/baseline")
        else:
            payload = F.struct("text", "chunk_id", "doc_id", "zone_id", *METADATA)
            rows.select(F.to_json(F.struct(F.col("chunk_id").alias("id"), "vector", payload.alias("payload"))).alias("value")).write.mode("overwrite").text(f"{folder}/chunks")
        knowledge, baseline = self.counts(zone_id)
        manifest = {
            "zone_id": zone_id, "engine": "spark", "embedding_model": self.model, "embedding_dim": self.dim, "distance": self.distance, "normalized": self.distance == "cosine", "chunk_strategy": self.chunk_options,
            "build_time": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "record_count": knowledge, "baseline_count": baseline, "schema_version": SCHEMA_VERSION,
        }
        text = json.dumps(manifest, indent=2, ensure_ascii=False)
        self._write(f"{folder}/manifest.json", text)
        parts = [f"{folder}/{d}" for d in (("chunks", "baseline") if form == "parquet" else ("chunks",))]
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(parts)
        sums = {r.name: r.sum for r in files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sum")).collect()}
        sums["manifest.json"] = hashlib.sha256(text.encode()).hexdigest()
        self._write(f"{folder}/checksums.json", json.dumps(sums, indent=2, sort_keys=True))
        return manifest
