"""Dedup operators: within a document's chunks, and exact ones over any key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnkit.exceptions import TextProcessingError
from cairnkit.functions import worker
from cairnkit.functions.text import let, strip

THRESHOLD, PERMUTATIONS, SHINGLE = 0.85, 128, 5
BLOCK = 256


def exact(chunks: Column) -> Column:
    """Stripped chunks without empty ones, each text at its first place."""
    return worker.lifted(worker.distinct)(chunks)


def exact_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by `order` of each combination of keys."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """The distinct character runs of the given size; a shorter text is one shingle, a blank one none."""

    def made(flat: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(flat) - size + 1)), lambda i: F.substring(flat, i, F.lit(size)))
        return F.when(F.length(flat) == 0, F.array().cast("array<string>")).when(F.length(flat) <= size, F.array(flat)).otherwise(F.array_distinct(runs))

    return let(strip(F.regexp_replace(text, r"(?U)\s+", " ")), made)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct items; that of two empty ones is 1."""

    def share(both: Column) -> Column:
        every = F.size(a) + F.size(b) - both
        return F.when(every == 0, F.lit(1.0)).otherwise(both / every)

    return let(F.size(F.array_intersect(a, b)), share)


def _shingle_ids(texts: list[str], size: int) -> list[np.ndarray]:
    """Each text's distinct character runs as sorted numbers, equal for equal runs of any of the texts: no hashes."""
    points = [np.frombuffer(worker.flat(t).encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    letters = np.unique(np.concatenate(points))
    base = len(letters) + 1
    if base**size >= 2**63:  # too many letters for one number a run
        known: dict[bytes, int] = {}
        runs = [{p[i : i + size].tobytes() for i in range(max(1, len(p) - size + 1))} for p in points]
        return [np.array(sorted(known.setdefault(r, len(known)) for r in found), dtype=np.int64) for found in runs]
    found = []
    for p in points:
        digits = np.searchsorted(letters, p).astype(np.int64) + 1
        width = min(size, len(p))
        code = digits[: len(p) - width + 1].copy()
        for k in range(1, width):
            code *= base
            code += digits[k : len(p) - width + 1 + k]
        found.append(np.unique(code))
    return found


def _fold_jaccard(chunks: list[str | None], threshold: float, size: int) -> list[str]:
    texts = worker.distinct(chunks)
    if len(texts) < 2:
        return texts
    found = _shingle_ids(texts, size)
    every, places = np.unique(np.concatenate(found), return_inverse=True)
    sizes = np.array([len(x) for x in found])
    ends = np.cumsum(sizes)
    ids = [places[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    mark, kept = np.zeros(len(every), dtype=np.uint8), []
    for i, mine in enumerate(ids):
        n = sizes[i]
        mark[mine] = 1
        near = [j for j in kept if min(n, sizes[j]) / max(n, sizes[j]) >= threshold]
        if not any((both := int(np.count_nonzero(mark[ids[j]]))) / (n + sizes[j] - both) >= threshold for j in reversed(near)):
            kept.append(i)
        mark[mine] = 0
    return [texts[i] for i in kept]


def greedy(chunks: Column, threshold: float = THRESHOLD, size: int = SHINGLE) -> Column:
    """Chunks that no earlier kept one is similar to, by exact Jaccard of shingles: a fold within the row.

    Its comparisons grow with the square of a document's chunks, not of the table's. Shingles
    are numbered exactly, and chunks whose counts alone exclude the threshold aren't compared.
    """
    return worker.lifted(lambda c: _fold_jaccard(c, threshold, size))(chunks)


_LANES = {}


def _lanes(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    if permutations not in _LANES:
        rng = np.random.default_rng(1)
        _LANES[permutations] = rng.integers(1, 2**64, permutations, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, permutations, dtype=np.uint64)
    return _LANES[permutations]


def signature(text: str, permutations: int = PERMUTATIONS, size: int = SHINGLE) -> np.ndarray:
    """The least of each hash over the text's shingles."""
    flat = " ".join(text.split())
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    width = min(size, len(points))
    items = np.full(len(points) - width + 1, np.uint64(len(points)) if len(points) < size else np.uint64(0))
    for k in range(width):
        items = items * np.uint64(0x100000001B3) + points[k : len(points) - width + 1 + k]
    items = np.unique(items ^ (items >> np.uint64(29)))
    a, b = _lanes(permutations)
    least = np.full(permutations, np.iinfo(np.uint64).max)
    for at in range(0, len(items), BLOCK):  # a block of all lanes stays in the cache
        x = items[at : at + BLOCK, None] * a
        x += b
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def minhash(df: DataFrame, column: str, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, size: int = SHINGLE) -> DataFrame:
    """df with its column of chunks as greedy() would leave it, by the share of equal slots of MinHash signatures.

    A row's chunks are folded in order: a chunk goes if any kept one before it is similar. The
    estimate is within about 1 / sqrt(permutations) of the Jaccard similarity. Runs over
    Arrow batches; rows stay where they are, null arrays stay null.
    """
    permutations, size, threshold = max(16, permutations), max(2, size), min(1.0, max(0.0, threshold))
    at, schema = df.columns.index(column), df.schema

    def fold(texts: list[str]) -> list[str]:
        solid = [x for x in (t.strip() for t in texts if t is not None) if x]
        if len(solid) < 2:
            return solid
        kept, table = [], np.empty((len(solid), permutations), dtype=np.uint64)
        for text in solid:
            s = signature(text, permutations, size)
            if not kept or (table[: len(kept)] == s).mean(axis=1).max() < threshold:
                table[len(kept)] = s
                kept.append(text)
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = [None if texts is None else fold(texts) for texts in batch.column(at).to_pylist()]
            columns = [*batch.columns[:at], pa.array(folded, pa.list_(pa.string())), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    worker.bound()
    return df.mapInArrow(run, schema)


def dedup_chunks(df: DataFrame, column: str, strategy: str = "exact", **options) -> DataFrame:
    """df with its column of chunks deduplicated: exact (the default), jaccard or minhash, by name."""
    name = strategy.strip().lower()
    if name == "minhash":
        return minhash(df, column, **options)
    if name not in ("exact", "jaccard"):
        raise TextProcessingError(f"unknown dedup strategy {strategy}")
    return df.withColumn(column, exact(F.col(column)) if name == "exact" else greedy(F.col(column), **options))


def dropped(before: Column, after: Column) -> Column:
    return F.greatest(F.lit(0), F.size(before) - F.size(after))
