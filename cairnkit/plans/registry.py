"""Registered queries of the engine's operators; their SQL is in oracles.py under the same names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnkit.functions import text as T
from cairnkit.functions.lineage import shared_folder
from cairnkit.operators import chunk, clean, dedup, dense, encode, hybrid, sparse
from cairnkit.options import Options
from cairnkit.plans import ingest, store, tables
from cairnkit.plans.oracles import ORACLES
from cairnkit.sources import files

__all__ = ["ORACLES", "QUERIES"]
QUERIES: dict = {}
WIDE = "Ａ！　"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str, column: Column, name: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("doc_id", column.alias(name))


def _chunk_rows(spark: SparkSession, sf_dir: str, chunks: Column) -> DataFrame:
    return _documents(spark, sf_dir, chunks, "chunks").select("doc_id", F.posexplode("chunks").alias("pos", "chunk"))


@query
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunk records, end to end, with deterministic vectors."""
    docs = tables.source_docs(spark, sf_dir)
    made = ingest.records(docs, tables.zone(F.col("doc_no")), tables.record_type(F.col("doc_no")), Options(embedding_mode="fake"))
    first = F.round(F.element_at("vector", 1).cast("double"), 6).alias("v1")
    return made.select("chunk_id", "doc_id", "zone_id", "record_type", "text", "filename", "source_path", "extension", "chunk_index", "chunk_count", "char_len", "content_hash", "size_bytes", "file_type", "language", F.size("vector").alias("dim"), first)


@query
def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ingest.with_metadata(tables.source_docs(spark, sf_dir))
    return made.select("doc_no", "doc_id", "filename", "extension", "file_type", "size_bytes")


@query
def clean_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit("﻿ \t"), F.replace(F.col("text"), F.lit("\n"), F.lit(" \r\n \r")), F.lit("\x00\x07\x7fx\t \n\n"))
    return _documents(spark, sf_dir, clean.basic_clean(dirty), "cleaned")


@query
def normalize_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit(WIDE), F.replace(F.col("text"), F.lit(". "), F.lit(". 　 ")), F.lit(" é \t \n z \t"))
    return _documents(spark, sf_dir, clean.normalize_prose(dirty), "cleaned")


@query
def clean_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit("  " + WIDE), F.replace(F.col("text"), F.lit("\n"), F.lit("  \t\n    ")), F.lit(" \n"))
    return _documents(spark, sf_dir, clean.clean_code(clean.normalize_code(dirty)), "cleaned")


@query
def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.table(spark, sf_dir, "pages")
    dirty = F.replace(F.col("html"), F.lit("</p>"), F.lit("</p> \n\n\n\n<!-- a\nb -->"))
    return pages.select("page_id", clean.clean_markdown(dirty).alias("cleaned"))


@query
def pdf_header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents in a row as the pages of one, under a repeated head and above a repeated foot."""
    docs = tables.table(spark, sf_dir, "documents")
    file = F.floor(F.col("doc_id") / 5)
    text = F.concat(F.lit("Report "), file.cast("string"), F.lit(" HEADER\n"), F.col("text"), F.lit("\n  CONFIDENTIAL  \n"))
    pages = docs.select(file.alias("doc_id"), (F.col("doc_id") % 5).alias("page_no"), text.alias("page_text"))
    return clean.clean_pages(pages, normalize=False)


@query
def md_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = tables.table(spark, sf_dir, "nation")
    head = F.array(F.lit("nation|name"), F.lit("key\nnumber"), F.lit("x"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.array(r["n_name"], r["n_nationkey"].cast("string")))
    return nation.groupBy(F.col("n_regionkey").alias("region")).agg(rows.alias("rows")).select("region", files.markdown_table(F.concat(F.array(head), F.col("rows"))).alias("markdown"))


@query
def chunk_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir, chunk.fixed_window(F.col("text"), 40, 8))


@query
def chunk_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir, chunk.hybrid(F.col("text"), 60, 10))


@query
def chunk_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir, chunk.by_line(F.col("text"), 60, 10))


@query
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.replace(F.col("text"), F.lit("on.\n"), F.lit("on.\n \n\n"))
    return _chunk_rows(spark, sf_dir, chunk.by_paragraph(spaced, 60, 10))


@query
def semantic_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    found = chunk.semantic_breaks(docs, lambda t: encode.fake(t, 32))
    return found.select("doc_id", "pos", "sentence", F.round("distance", 6).alias("distance"), "is_break")


@query
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's distinct lines at their first places."""
    return _chunk_rows(spark, sf_dir, dedup.exact(F.split("text", "\n", -1)))


@query
def dedup_exact_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").withColumn("hash", T.content_hash(F.col("text")))
    return dedup.exact_rows(docs.select("doc_id", "hash"), ["hash"], ["doc_id"])


@query
def dropped_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.source_docs(spark, sf_dir)
    return ingest.stats(docs, Options(chunk_strategy="paragraph", chunk_max_tokens=60, chunk_overlap=10))


@query
def dedup_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir, dedup.greedy(chunk.hybrid(F.col("text")), 0.3))


@query
def dedup_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, chunk.hybrid(F.col("text")), "chunks")
    return dedup.minhash(docs, "chunks", 0.3).select("doc_id", F.posexplode("chunks").alias("pos", "chunk"))


@query
def fake_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", encode.fake(F.col("text")).alias("v"))
    return docs.select("doc_id", F.posexplode("v").alias("i", "v")).select("doc_id", "i", F.round("v", 9).alias("v"))


@query
def align_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", encode.align(F.col("embedding"), 48).alias("cut"), encode.align(F.col("embedding"), 70).alias("filled"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as stored chunks, with what the checks below look at."""
    rows = tables.doc_chunks(spark, sf_dir)
    null = {"vector": "array<float>", "extension": "string", "source_path": "string", "content_hash": "string", "file_type": "string", "chunk_index": "int", "chunk_count": "int", "char_len": "int", "mtime": "bigint", "size_bytes": "bigint"}
    return rows.select("*", F.col("doc_no").cast("string").alias("doc_id"), *[F.lit(None).cast(t).alias(n) for n, t in null.items()], F.lit(False).alias("is_deleted"), F.lit(1).cast("bigint").alias("created_at"), F.lit(1).cast("bigint").alias("updated_at"))


def _seen(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", "zone_id", "record_type", F.sha1("text").alias("text_hash"), "is_deleted", "created_at", "updated_at")


@query
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch with new texts for the English chunks, and copies of the French ones under new ids."""
    old = _stored(spark, sf_dir)
    new = old.where("language in ('en', 'fr')").withColumns({"text": F.concat(F.lit("v2 "), "text"), "chunk_id": F.when(F.col("language") == "fr", F.concat(F.lit("new-"), "chunk_id")).otherwise(F.col("chunk_id"))})
    return _seen(store.merge(old, new, F.lit(2).cast("bigint")))


@query
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch that holds every chunk twice."""
    rows = _stored(spark, sf_dir).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("text", F.concat(F.col("n").cast("string"), "text"))
    return _seen(store.latest(rows, F.col("n")))


@query
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(store.soft_delete(_stored(spark, sf_dir), F.col("language") == "fr", F.lit(3).cast("bigint")))


@query
def delete_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(store.soft_delete(_stored(spark, sf_dir), F.col("doc_id") == "7", F.lit(4).cast("bigint")))


@query
def zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.zone_counts(store.soft_delete(_stored(spark, sf_dir), F.col("language") == "fr", F.lit(3).cast("bigint")))


@query
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir).where("record_type = 'baseline'")
    return rows.select("vec_id", "zone_id", "embedding")


@query
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted part of each zone's manifest."""
    counts = store.zone_counts(_stored(spark, sf_dir))
    return counts.select("zone_id", F.lit("spark").alias("engine"), F.lit(store.SCHEMA_VERSION).alias("schema_version"), "record_count", "baseline_count")


@query
def ext_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/a.b/"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".TXT", ".md", ".tar.gz", ""))), (F.length("text") % 4 + 1).cast("int"))).alias("source_path"))
    return files.extension_histogram(names)


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return tables.table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding


def _dense(spark: SparkSession, sf_dir: str, metric: str = "cosine", **options) -> DataFrame:
    found = dense.top_k(tables.vectors(spark, sf_dir), _first_vector(spark, sf_dir), 20, metric=metric, id_col="vec_id", vector_col="embedding", **options)
    return found.select("vec_id", "zone_id", "record_type", F.round("score", 6).alias("score"), "rank")


@query
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


@query
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline rows of one zone only."""
    found = dense.top_k(tables.vectors(spark, sf_dir).where("zone_id = 'ai'"), _first_vector(spark, sf_dir), 20, {"record_type": "baseline"}, id_col="vec_id", vector_col="embedding")
    return found.select("vec_id", "zone_id", "record_type", F.round("score", 6).alias("score"), "rank")


@query
def dense_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "dot")


@query
def dense_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "euclid")


@query
def dense_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """160 candidates first, filtered by language after."""
    rows = tables.vectors(spark, sf_dir).withColumn("language", F.when(F.col("label") < 3, "en").otherwise("de"))
    found = dense.top_k(rows, _first_vector(spark, sf_dir), 20, {"language": "de"}, id_col="vec_id", vector_col="embedding", overfetch=8)
    return found.select("vec_id", "language", F.round("score", 6).alias("score"), "rank")


@query
def dense_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query against its zone."""
    rows = tables.vectors(spark, sf_dir)
    asked = rows.select(F.col("vec_id").alias("query_id"), "zone_id", F.col("embedding").alias("query"))
    return dense.batch_top_k(rows, asked, 5, id_col="vec_id", vector_col="embedding").select("query_id", "vec_id", "zone_id", F.round("score", 6).alias("score"), "rank")


@query
def bm25_zone_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.terms_stats(sparse.okapi_terms(tables.doc_chunks(spark, sf_dir))).select("zone_id", "n", F.round("avgdl", 6).alias("avgdl"))


def _allowed() -> Column:
    return F.col("record_type") == "knowledge"


@query
def bm25_okapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.doc_chunks(spark, sf_dir)
    found = sparse.okapi_best(rows, tables.queries(spark, sf_dir), 10, _allowed())
    return found.select("query_id", "zone_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query
def bm25_fts5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.doc_chunks(spark, sf_dir)
    found = sparse.fulltext_best(rows, tables.queries(spark, sf_dir), 10, _allowed())
    return found.select("query_id", "zone_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and keyword rankings of 50 for every benchmark text, fused to 10."""
    rows, asked = tables.doc_chunks(spark, sf_dir), tables.queries(spark, sf_dir)
    live = rows.where(_allowed()).withColumn("vector", encode.fake(F.col("text"), 64))
    one = dense.batch_top_k(live, asked.withColumn("query", encode.fake(F.col("query"), 64)), 50)
    two = sparse.okapi_best(rows, asked, 50, _allowed())
    found = hybrid.fuse(one, two, 10)
    return found.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "dense_rank", "sparse_rank", "rank")


@query
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of each label's vectors, by two of their places."""
    e = tables.table(spark, sf_dir, "embeddings")
    from pyspark.sql import Window

    def ranked(place: int) -> DataFrame:
        by = Window.partitionBy("label").orderBy(F.element_at("embedding", place).desc(), "vec_id")
        return e.select(F.col("label").alias("query_id"), F.col("vec_id").alias("chunk_id"), F.row_number().over(by).alias("rank")).where("rank <= 30")

    return hybrid.fuse(ranked(1), ranked(2), 20).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "dense_rank", "sparse_rank", "rank")
