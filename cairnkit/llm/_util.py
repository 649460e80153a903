"""Shared helpers: lineage cuts, hashing and walking sorted Arrow batches by key."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnkit.functions.lineage import cut, shared_folder

__all__ = ["cut", "shared_folder"]

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _at(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    files, where = _at(spark, path)
    files.delete(where, True)


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on, and what it holds counts for its executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(texts: DataFrame) -> DataFrame:
    """texts, whose session sends at most about BATCH_BYTES at a time to a worker unless it has a bound of its own.

    By Spark's own bounds a batch of texts takes tens of MB, which the executor and the worker
    both hold. The bound stays set in the session. A row is never cut.
    """
    if texts.sparkSession.conf.get(_BATCH, None) is None:
        texts.sparkSession.conf.set(_BATCH, BATCH_BYTES)
    return texts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is overwritten."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def int64s(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys and where each run starts (with the end appended).

    The batches must come sorted by key, an int64 column without nulls, as
    sortWithinPartitions leaves them. A run that goes on in the next batch is held back.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = int64s(batch.column(key))
        last = int(np.searchsorted(keys, keys[-1]))
        if held and (last > 0 or int(held[-1].column(key)[-1].as_py()) != keys[0]):
            yield _runs(pa.Table.from_batches([*held, batch.slice(0, last)]), key)
            held = []
        elif last > 0:
            yield _runs(pa.Table.from_batches([batch.slice(0, last)]), key)
        held.append(batch.slice(last))
    if held:
        yield _runs(pa.Table.from_batches(held), key)


def _runs(table: pa.Table, key: str) -> tuple[pa.Table, np.ndarray]:
    table = table.combine_chunks()
    keys = table.column(key).to_numpy()
    return table, np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def linked(n: int, alike: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph on 0..n-1 whose edges are the pairs that alike accepts.

    alike(i, others) tells which of others are linked to i. Every pair that could join two
    parts is tried, so the parts are those of the full graph; what a vertex has taken into
    its part isn't compared again, which keeps a tight group near linear.
    """
    edges, rest = [], np.arange(n)
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = alike(at, rest)
            for other in rest[hit].tolist():
                edges.append((at, other))
                queue.append(other)
            rest = rest[~hit]
    return edges


BROADCAST_BYTES = 100 << 20


def _bytes_of(column: Column, kind: T.DataType) -> Column:
    """About what a value takes in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        size = F.octet_length(column) + 24
    elif isinstance(kind, T.ArrayType):
        each = 8 * max(1, len(kind.elementType.fields)) + 8 if isinstance(kind.elementType, T.StructType) else 8
        size = F.size(column) * each + 24
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows take at most that many bytes; else as it is, for a shuffle join.

    df is read for this, so it should be cut beforehand. Nested arrays of strings or arrays
    aren't measured and mustn't be among its columns.
    """
    taken = sum((_bytes_of(df[f.name], f.dataType) for f in df.schema), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(taken)).first()[0] or 0) <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """name, led by underscores until no column of df is called so in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among ids (one bigint column, cut beforehand)."""
    name = fresh(docs, "gone")
    gone = small(ids.select(F.col(ids.columns[0]).alias(name)))
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
