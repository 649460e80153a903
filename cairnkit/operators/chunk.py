"""Chunking operators: a text column to an array of chunks, in the workers and without a shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnkit.exceptions import ChunkingError
from cairnkit.functions import worker
from cairnkit.functions.text import strip

MAX_TOKENS, OVERLAP = 300, 50
CELLS = 1 << 20
SENTENCE = r"(?<=[。！？．.?!])\s+"
BREAKPOINTS = ("percentile", "standard_deviation", "interquartile", "gradient")


def _check(max_tokens: int, overlap: int) -> None:
    if max_tokens <= 0:
        raise ChunkingError("max_tokens must be positive")
    if not 0 <= overlap < max_tokens:
        raise ChunkingError("overlap must be from 0 to below max_tokens")


def fixed_window(text: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """Windows of max_tokens words, or characters where the text has no space, overlapping by `overlap`."""
    _check(max_tokens, overlap)
    return worker.lifted(lambda t: worker.windows(worker.strip(t), max_tokens, overlap))(text)


def hybrid(text: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """Lines packed into chunks while they fit and are of one kind; lines too long by windows.

    Words are joined by a space, lines of characters without anything between.
    """
    _check(max_tokens, overlap)
    return worker.lifted(lambda t: worker.hybrid(t, max_tokens, overlap))(text)


def by_line(text: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """Lines packed with their line ends; the budget counts the joined lines' tokens.

    Joined lines count as words once any of them has a space, else as characters with the
    line ends, so that both counts are carried and the open chunk is never split anew.
    """
    _check(max_tokens, overlap)
    return worker.lifted(lambda t: worker.by_line(t, max_tokens, overlap))(text)


def by_paragraph(text: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """Parts between blank lines, or lines where there is only one part; long ones by windows."""
    _check(max_tokens, overlap)
    return worker.lifted(lambda t: worker.by_paragraph(t, max_tokens, overlap))(text)


def enforce_max(chunks: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """Chunks stripped, without empty ones, and those too long cut by windows."""
    _check(max_tokens, overlap)
    return worker.lifted(lambda c: worker.enforce_max(c, max_tokens, overlap))(chunks)


def sentences(text: Column, pattern: str = SENTENCE) -> Column:
    return F.filter(F.split(strip(text), "(?U)" + pattern, -1), lambda x: x != "")


def semantic_breaks(docs: DataFrame, embed: Callable[[Column], Column], kind: str = "percentile", amount: float = 90.0, id_col: str = "doc_id", text_col: str = "text", pattern: str = SENTENCE) -> DataFrame:
    """(doc_id, pos, sentence, distance, is_break) of every sentence, in semantic chunking.

    A sentence is embedded with its neighbour on either side. distance is 1 - cosine to the
    next one's embedding (null for the last), and a break follows where it, or its gradient,
    is above the document's threshold. embed maps a text column to an array of doubles. A
    document's sentences follow each other where it is read, so that nothing is shuffled.
    Zero vectors, and neighbours of different length, have no distance.
    """
    if kind not in BREAKPOINTS:
        raise ChunkingError(f"unknown breakpoint type {kind}")
    rows = docs.select(F.col(id_col).alias("doc_id"), sentences(F.col(text_col), pattern).alias("all"))
    rows = rows.select("doc_id", "all", F.posexplode("all").alias("pos", "sentence"))
    around = F.concat_ws(" ", F.get("all", F.col("pos") - 1), F.col("sentence"), F.get("all", F.col("pos") + 1))
    rows = rows.select("doc_id", "pos", "sentence", around.alias("around"))
    rows = rows.select("doc_id", "pos", "sentence", embed(F.col("around")).cast("array<double>").alias("v"))
    kinds = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the document that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(batch.column(1).to_numpy() == 0)
            if not len(starts):
                held.append(batch)
                continue
            yield from _broken([*held, batch.slice(0, starts[-1])], kind, amount)
            held = [batch.slice(starts[-1])]
        yield from _broken(held, kind, amount)

    worker.bound()
    return rows.mapInArrow(run, T.StructType([*kinds.fields[:3], T.StructField("distance", T.DoubleType()), T.StructField("is_break", T.BooleanType())]))


def _broken(parts: list[pa.RecordBatch], kind: str, amount: float) -> Iterator[pa.RecordBatch]:
    """Whole documents' rows (doc_id, pos, sentence, v) with distances and breaks instead of v."""
    parts = [p for p in parts if p.num_rows]
    if not parts:
        return
    pos = np.concatenate([p.column(1).to_numpy() for p in parts])
    n = len(pos)
    vectors = pa.chunked_array([p.column(3) for p in parts]).combine_chunks()
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = vectors.value_lengths().fill_null(-1).to_numpy()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    distance = np.full(n, np.nan)
    follows = np.flatnonzero((pos[1:] != 0) & (sizes[:-1] == sizes[1:]) & (sizes[:-1] > 0))
    for size in np.unique(sizes[follows]):
        one = follows[sizes[follows] == size]
        for begin in range(0, len(one), max(1, CELLS // int(size))):
            i = one[begin : begin + max(1, CELLS // int(size))]
            x, y = (flat[offsets[j][:, None] + np.arange(size)] for j in (i, i + 1))
            length = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            distance[i] = 1 - np.divide((x * y).sum(axis=1), length, out=np.full(len(i), np.nan), where=length > 0)
    breaks = np.zeros(n, dtype=bool)
    edges = [*np.flatnonzero(pos == 0).tolist(), n]
    for begin, end in zip(edges, edges[1:], strict=False):
        value = distance[begin:end]
        if kind == "gradient":
            value = _slopes(value)
        known = value[~np.isnan(value)]
        if len(known):
            breaks[begin:end] = value > _limit(known, kind, amount)
    made, gone = pa.array(distance, mask=np.isnan(distance)), pa.array(breaks)
    begin = 0
    for p in parts:
        yield pa.RecordBatch.from_arrays([*p.columns[:3], made.slice(begin, p.num_rows), gone.slice(begin, p.num_rows)], ["doc_id", "pos", "sentence", "distance", "is_break"])
        begin += p.num_rows


def _slopes(value: np.ndarray) -> np.ndarray:
    before, after = np.append(np.nan, value[:-1]), np.append(value[1:], np.nan)
    slope = np.where(np.isnan(before), after - value, np.where(np.isnan(after), value - before, (after - before) / 2))
    return np.where(np.isnan(value), np.nan, slope)


def _limit(known: np.ndarray, kind: str, amount: float) -> float:
    ordered = np.sort(known)

    def percentile(share: float) -> float:
        at = (len(ordered) - 1) * share
        low, high = math.floor(at), math.ceil(at)
        a, b = float(ordered[low]), float(ordered[high])
        return a if low == high or a == b else (high - at) * a + (at - low) * b

    if kind in ("percentile", "gradient"):
        return percentile(amount / 100)
    if kind == "standard_deviation":
        return float(known.mean() + amount * known.std())
    return float(known.mean() + amount * (percentile(0.75) - percentile(0.25)))


def semantic(docs: DataFrame, embed: Callable[[Column], Column], max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, **options) -> DataFrame:
    """(doc_id, chunks): sentences up to each break joined by a space, long ones cut by windows."""
    broken = semantic_breaks(docs, embed, **options)
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    grouped = broken.withColumn("part", F.coalesce(F.sum(F.col("is_break").cast("int")).over(order), F.lit(0)))
    parts = grouped.groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("s"))
    parts = parts.select("doc_id", "part", F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("text"))
    whole = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    return whole.select("doc_id", enforce_max(F.transform("p", lambda x: x["text"]), max_tokens, overlap).alias("chunks"))


STRATEGIES = {"fixed_window": fixed_window, "hybrid": hybrid, "line": by_line, "paragraph": by_paragraph}


def chunk_text(text: Column, strategy: str = "hybrid", max_tokens: int | None = None, overlap: int | None = None) -> Column:
    """Chunks by the strategy of that name, whatever its case; semantic() needs a DataFrame and an encoder."""
    name = strategy.strip().lower()
    if name not in STRATEGIES:
        raise ChunkingError(f"unknown chunk strategy {strategy}")
    return STRATEGIES[name](text, max_tokens or MAX_TOKENS, OVERLAP if overlap is None else overlap)
