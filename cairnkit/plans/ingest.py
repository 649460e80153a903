"""Documents to chunk records: clean, chunk, dedup, encode, assemble."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnkit.exceptions import ChunkingError
from cairnkit.functions import text as T
from cairnkit.operators import chunk, clean, dedup, encode
from cairnkit.options import Options
from cairnkit.schema import RECORD, RECORD_TYPES, assert_zone


def with_metadata(docs: DataFrame) -> DataFrame:
    """docs (source_path, text[, mtime, size_bytes]) with filename, extension, file_type, doc_id, size_bytes and mtime.

    In-memory texts have the UTF-8 size of their text and the current time. An extension that
    isn't known counts as text.
    """
    ext = T.extension(F.col("source_path"))
    size = F.octet_length("text").cast("bigint")
    return docs.select(
        *[c for c in docs.columns if c not in ("filename", "extension", "file_type", "size_bytes", "mtime", "doc_id")],
        T.filename(F.col("source_path")).alias("filename"),
        ext.alias("extension"),
        T.file_type(ext).alias("file_type"),
        (F.coalesce("size_bytes", size) if "size_bytes" in docs.columns else size).cast("bigint").alias("size_bytes"),
        (F.col("mtime") if "mtime" in docs.columns else F.unix_timestamp()).cast("bigint").alias("mtime"),
        T.doc_key(F.col("source_path")).alias("doc_id"),
    )


def _dedup(df: DataFrame, column: str, o: Options) -> DataFrame:
    name = o.dedup_strategy.strip().lower()
    extra = {} if name == "exact" else {"threshold": o.dedup_minhash_threshold, "size": o.dedup_shingle_size}
    return dedup.dedup_chunks(df, column, name, **extra | ({"permutations": o.dedup_minhash_perm} if name == "minhash" else {}))


def cleaned(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """with_metadata(docs) with text cleaned by file type."""
    o = (options or Options()).checked()
    return with_metadata(docs).withColumn("text", clean.clean_text(F.col("text"), F.col("file_type"), o.preserve_indent))


def chunked(docs: DataFrame, options: Options | None = None, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """cleaned(docs) with `chunks`, deduplicated within each document."""
    o = (options or Options()).checked()
    ready = cleaned(docs, o)
    if o.chunk_strategy.strip().lower() != "semantic":
        made = chunk.chunk_text(F.col("text"), o.chunk_strategy, o.chunk_max_tokens, o.chunk_overlap)
        return _dedup(ready.withColumn("chunks", made), "chunks", o)
    if o.embedding_mode == "fake" and embed is None:
        raise ChunkingError("semantic chunks need an encoder with meaning; fake vectors have none")
    embed = embed or encode.build(o.embedding_mode, o.embedding_model, o.embedding_dim)
    parts = chunk.semantic(ready, embed, o.chunk_max_tokens, o.chunk_overlap, kind=o.semantic_breakpoint_type, amount=o.semantic_breakpoint_amount, pattern=o.semantic_sentence_split_regex)
    return ready.join(_dedup(parts, "chunks", o), "doc_id", "left")


def records(docs: DataFrame, zone_id: str | Column, record_type: str | Column = "knowledge", options: Options | None = None, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunk records of docs (source_path, text[, language, mtime, size_bytes]).

    chunk_index and chunk_count are those after dedup, char_len counts code points and
    chunk_id follows from document, place and content, so that a rerun gives the same ids.
    Documents that are empty after cleaning have no record; errors() lists them. Nothing is
    shuffled, except for semantic chunks.
    """
    if isinstance(zone_id, str):
        zone_id = F.lit(assert_zone(zone_id))
    if isinstance(record_type, str):
        if record_type not in RECORD_TYPES:
            raise ValueError(f"record_type must be one of {', '.join(RECORD_TYPES)}")
        record_type = F.lit(record_type)
    o = (options or Options()).checked()
    made = chunked(docs, o, embed).select("*", zone_id.alias("_zone"), record_type.alias("_type"))
    rows = made.select("*", F.size("chunks").alias("chunk_count"), F.posexplode("chunks").alias("chunk_index", "chunk"))
    content = T.content_hash(F.col("chunk"))
    vector = (embed or encode.build(o.embedding_mode, o.embedding_model, o.embedding_dim))(F.col("chunk"))
    found = {
        "chunk_id": T.chunk_key(F.col("doc_id"), F.col("chunk_index"), content),
        "zone_id": F.col("_zone"),
        "record_type": F.col("_type"),
        "text": F.col("chunk"),
        "vector": vector,
        "char_len": F.length("chunk"),
        "content_hash": content,
        "language": F.col("language") if "language" in docs.columns else F.lit(None),
    }
    columns = [tuple(c.strip().split(" ")) for c in RECORD.split(",")]
    return rows.select(*[found.get(name, F.col(name)).cast(kind).alias(name) for name, kind in columns])


def errors(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """(source_path, error) of the documents that give no record."""
    ready = cleaned(docs, options)
    return ready.where("text is null or text = ''").select("source_path", F.when(F.col("text").isNull(), "no text").otherwise("empty after cleaning").alias("error"))


def stats(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """(doc_id, n_chunks, n_deduped, dropped_duplicates) of each document."""
    o = (options or Options()).checked()
    before = chunk.chunk_text(F.col("text"), o.chunk_strategy, o.chunk_max_tokens, o.chunk_overlap)
    ready = _dedup(cleaned(docs, o).select("doc_id", before.alias("before")).withColumn("after", F.col("before")), "after", o)
    return ready.select("doc_id", F.size("before").alias("n_chunks"), F.size("after").alias("n_deduped"), dedup.dropped(F.col("before"), F.col("after")).alias("dropped_duplicates"))
