"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnkit.llm._util import cut

LOCAL_EDGES = 4_000_000


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) for every node of edges (a, b), root the least node of its component.

    a and b are bigints. Null ends are left out, loops and repeats change nothing. Up to
    local_edges edges (16 bytes each) are joined in one task by union-find; beyond that the
    star contraction below does it over all executors, with the same result.
    """
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b"))
    if edges.limit(local_edges + 1).count() <= local_edges:
        return edges.coalesce(1).mapInArrow(_union_find, "node long, root long")
    return _contract(edges)


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    if not a or not sum(map(len, a)):
        return
    names, ends = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    half = len(ends) // 2
    for x, y in zip(ends[:half].tolist(), ends[half:].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([find(x) for x in range(len(names))])
    for at in range(0, len(names), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 100_000]), pa.array(names[roots[at : at + 100_000]])], ["node", "root"])


def _contract(edges: DataFrame) -> DataFrame:
    """Large-star and small-star steps until every edge is a leaf's edge to its root."""
    by_u = Window.partitionBy("u")
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        least = both.withColumn("m", F.least("u", F.min("v").over(by_u)))
        edges = least.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).withColumn("m", F.min("v").over(by_u))
        edges = down.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = cut(edges)
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(edges.select(F.col("b"), F.col("b")).distinct())
        mark = seen
