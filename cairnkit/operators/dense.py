"""Dense retrieval: exact top-k of vectors under a zone and equality filters."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

FILTERABLE = frozenset({"doc_id", "filename", "source_path", "extension", "file_type", "language", "record_type"})
METRICS = ("cosine", "dot", "euclid")
BROADCAST_QUERIES = 4096
CELLS = 1 << 22  # scores worked out at once
DECIMALS = 12  # so that equal vectors tie, wherever they lie in a matrix product


def normalize_filters(filters: dict[str, Any] | None) -> dict[str, Any]:
    """The filters that count: known fields with scalar values, and record_type, `knowledge` unless given."""
    given = filters or {}
    kept = {k: v for k, v in given.items() if k in FILTERABLE and isinstance(v, str | int | float | bool)}
    if ignored := sorted(given.keys() - kept.keys()):
        warnings.warn(f"filters ignored: {', '.join(ignored)}", stacklevel=2)
    return {"record_type": "knowledge"} | kept


def predicate(filters: dict[str, Any]) -> Column:
    """All of them by equality; values are compared as strings, as the columns are."""
    every = F.lit(True)
    for name, value in filters.items():
        every = every & (F.col(name) == F.lit(str(value)))
    return every


def scores(vector: Column, query: list[float], metric: str = "cosine") -> Column:
    """Similarity of a vector column to one query, a matrix product an Arrow batch; distance for euclid.

    Null vectors, and those of another length, have a null score.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    q = np.array(query, dtype=np.float64)
    if metric == "cosine" and (n := np.linalg.norm(q)) > 0:
        q = q / n

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        good = sizes == len(q)
        out = np.full(len(column), np.nan)
        if good.any():
            x = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
            if metric == "euclid":
                out[good] = np.round(np.sqrt(((x - q) ** 2).sum(axis=1)), DECIMALS)
            else:
                s = x @ q
                if metric == "cosine":
                    length = np.linalg.norm(x, axis=1)
                    s = np.divide(s, length, out=np.zeros_like(s), where=length > 0)
                out[good] = np.round(s, DECIMALS)
        return pa.array(out, mask=~good)

    return run(vector)


def top_k(chunks: DataFrame, query: list[float], k: int = 10, filters: dict[str, Any] | None = None, metric: str = "cosine", id_col: str = "chunk_id", vector_col: str = "vector", overfetch: int | None = None) -> DataFrame:
    """The k best rows of chunks with columns score and rank; ties by id.

    Filters are applied first, so that k rows come back whenever k match. With overfetch the
    k * overfetch best of all `knowledge` rows are taken first and filtered after. Larger
    scores are better, but for euclid, whose score is the distance.
    """
    if k <= 0:
        return chunks.limit(0).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0))
    wanted = normalize_filters(filters)
    order = [F.col("score").asc() if metric == "euclid" else F.col("score").desc(), F.col(id_col).asc()]
    if overfetch is None or wanted["record_type"] != "knowledge":
        found = chunks.where(predicate(wanted)).withColumn("score", scores(F.col(vector_col), query, metric)).where("score is not null")
    else:
        found = chunks.where("record_type = 'knowledge'").withColumn("score", scores(F.col(vector_col), query, metric)).where("score is not null")
        found = found.orderBy(*order).limit(k * max(1, overfetch)).where(predicate(wanted))
    best = found.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def batch_top_k(chunks: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "chunk_id", vector_col: str = "vector", broadcast_queries: int = BROADCAST_QUERIES) -> DataFrame:
    """(query_id, <id>, zone_id, score, rank): the k best chunks of its zone for each query (query_id, zone_id, query).

    Queries travel to the chunks, at most broadcast_queries (64 at least) at a time, and each
    Arrow batch passes on only its k best per query; ranks come from one window over what is
    left. More queries are taken in turns, with the same results. Null vectors, and queries
    and chunks of different length, give no rows.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    sign = 1.0 if metric == "euclid" else -1.0
    slim = chunks.select(F.col(id_col).alias("_id"), "zone_id", F.col(vector_col).cast("array<double>").alias("_v")).where("_v is not null")
    asked = queries.select("query_id", "zone_id", F.col("query").cast("array<double>").alias("query")).where("query is not null and zone_id is not null")
    kinds = [asked.schema["query_id"].dataType, slim.schema["_id"].dataType, slim.schema["zone_id"].dataType]
    schema = T.StructType([*[T.StructField(n, t) for n, t in zip(("query_id", "_id", "zone_id"), kinds, strict=True)], T.StructField("score", T.DoubleType())])
    key, zone_kind = to_arrow_type(kinds[0]), to_arrow_type(kinds[2])
    at_once = max(64, broadcast_queries)
    some = asked.limit(at_once + 1).collect()
    turns = [some] if len(some) <= at_once else _turns(asked, at_once)
    found = slim.sparkSession.createDataFrame([], schema)
    for turn in turns:
        groups: dict[tuple, tuple[list, list]] = {}
        for r in turn:
            names, vectors = groups.setdefault((r.zone_id, len(r["query"])), ([], []))
            names.append(r.query_id)
            vectors.append(r["query"])
        sent = slim.sparkSession.sparkContext.broadcast({at: (names, np.array(vectors, dtype=np.float64)) for at, (names, vectors) in groups.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, zones = batch.column(0), np.array(batch.column(1).to_pylist(), dtype=object)
                sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
                for (zone, size), (names, q) in sent.value.items():
                    at = np.flatnonzero((zones == zone) & (sizes == size))
                    if not len(at) or not size:
                        continue
                    x = batch.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                    step = max(1, CELLS // (len(at) * (size if metric == "euclid" else 1)))
                    for begin in range(0, len(q), step):
                        s = sign * _matrix_scores(q[begin : begin + step], x, metric)
                        edge = np.partition(s, min(k, len(at)) - 1, axis=1)[:, min(k, len(at)) - 1]
                        row, pick = np.nonzero(s <= edge[:, None])
                        yield pa.RecordBatch.from_arrays([pa.array([names[begin + r] for r in row.tolist()], key), ids.take(pa.array(at[pick])), pa.array([zone] * len(row), zone_kind), pa.array(sign * s[row, pick])], ["query_id", "_id", "zone_id", "score"])

        if k > 0 and groups:
            found = found.union(slim.mapInArrow(run, schema))
    best = Window.partitionBy("query_id").orderBy((F.col("score") * sign).asc(), F.col("_id").asc())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("_id", id_col)


def _turns(asked: DataFrame, at_once: int) -> Iterator[list]:
    """The queries in runs of at_once, read one partition at a time."""
    rows = asked.toLocalIterator()
    while turn := list(islice(rows, at_once)):
        yield turn


def _matrix_scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclid":
        return np.round(np.sqrt(np.maximum(0, ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))), DECIMALS)
    s = q @ x.T
    if metric == "cosine":
        length = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
        s = np.divide(s, length, out=np.zeros_like(s), where=length > 0)
    return np.round(s, DECIMALS)
