"""The chunk record: columns, closed value sets and checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZONES = ("cyber", "ai", "crypto")
RECORD_TYPES = ("knowledge", "baseline")
KINDS = ("text", "markdown", "code", "pdf", "docx")
METADATA = ("filename", "source_path", "extension", "chunk_index", "chunk_count", "char_len", "content_hash", "mtime", "size_bytes", "file_type", "language", "record_type")
RECORD = (
    "chunk_id string, doc_id string, zone_id string, record_type string, text string, vector array<float>, filename string, source_path string, extension string, "
    "chunk_index int, chunk_count int, char_len int, content_hash string, mtime bigint, size_bytes bigint, file_type string, language string"
)
STORED = RECORD + ", is_deleted boolean, created_at bigint, updated_at bigint"
HIT = "chunk_id string, doc_id string, zone_id string, score double, text string, metadata struct<filename:string,source_path:string,extension:string,chunk_index:int,chunk_count:int,char_len:int,content_hash:string,mtime:bigint,size_bytes:bigint,file_type:string,language:string,record_type:string>, rank int"


@dataclass(frozen=True)
class UpsertResult:
    attempted: int
    inserted: int
    updated: int = 0


@dataclass(frozen=True)
class DeleteResult:
    requested: int
    deleted: int
    chunk_ids: list[str] = field(default_factory=list)


def assert_zone(zone_id: str) -> str:
    if zone_id not in ZONES:
        raise ValueError(f"unknown zone {zone_id!r}; zones are {', '.join(ZONES)}")
    return zone_id


def violations(records: DataFrame, zone_id: str | None = None, dim: int | None = None) -> dict[str, int]:
    """How many records break each rule, in one aggregation; rules that none breaks are left out."""
    rules = {
        "text is null": F.col("text").isNull(),
        "doc_id is null": F.col("doc_id").isNull(),
        "zone_id is unknown": ~F.coalesce(F.col("zone_id").isin(*ZONES), F.lit(False)),
        "record_type is unknown": ~F.coalesce(F.col("record_type").isin(*RECORD_TYPES), F.lit(False)),
        "file_type is unknown": ~F.coalesce(F.col("file_type").isin(*KINDS), F.lit(False)),
        "chunk_index is null or negative": ~F.coalesce(F.col("chunk_index") >= 0, F.lit(False)),
        "chunk_count is null or below 1": ~F.coalesce(F.col("chunk_count") > 0, F.lit(False)),
        "char_len is null or negative": ~F.coalesce(F.col("char_len") >= 0, F.lit(False)),
        "size_bytes is null or negative": ~F.coalesce(F.col("size_bytes") >= 0, F.lit(False)),
        "vector is null": F.col("vector").isNull(),
    }
    if zone_id is not None:
        rules["zone_id is not the target"] = ~F.col("zone_id").eqNullSafe(F.lit(zone_id))
    if dim is not None:
        rules["vector has another length"] = F.coalesce(F.size("vector"), F.lit(-1)) != dim
    found = records.agg(*[F.count_if(c).alias(k) for k, c in rules.items()]).first().asDict()
    return {k: n for k, n in found.items() if n}
