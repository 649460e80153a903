"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnkit.llm._util import cut

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
VNODES = 128
SLACK = 0.05


def ring(shards: tuple[str, ...] = SHARDS, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """(positions, shard of each): every shard's virtual nodes in clockwise order.

    A node's position is a hash of the shard's name and the node's number alone, so that
    adding or removing a shard moves no other shard's nodes.
    """
    nodes = sorted((int.from_bytes(hashlib.sha1(f"{name}#{k}".encode()).digest()[:8], "big", signed=True), name, i) for i, name in enumerate(shards) for k in range(vnodes))
    return np.array([p for p, _, _ in nodes], dtype=np.int64), np.array([i for _, _, i in nodes], dtype=np.int64)


def capacity(keys: int, shards: int, slack: float = SLACK) -> int:
    """The most keys that a shard takes: its even share and `slack` of it, rounded up."""
    return math.ceil(keys * (1 + slack) / shards)


def flow(arcs: np.ndarray, owner: np.ndarray, most: int, shards: int) -> list[tuple[int, int, int, int]]:
    """(arc, keys before, keys up to, shard): where each arc's keys go, in the order of their hashes.

    arcs counts the keys whose first node clockwise is each node. In every round all
    unplaced keys stand at a node; a shard takes those at its nodes, node by node along the
    ring and by hash within an arc, until it is full; the rest go on to the next node. The
    work depends on the nodes alone, not on the number of keys.
    """
    nodes = len(owner)
    room = [most] * shards
    queue: list[list[tuple[int, int, int]]] = [[(a, 0, int(n))] if n else [] for a, n in enumerate(arcs.tolist())]
    placed = []
    while any(queue):
        moved: list[list[tuple[int, int, int]]] = [[] for _ in range(nodes)]
        for at in range(nodes):
            s = int(owner[at])
            for arc, low, high in queue[at]:
                take = min(room[s], high - low)
                if take:
                    placed.append((arc, low, low + take, s))
                    room[s] -= take
                if low + take < high:
                    moved[(at + 1) % nodes].append((arc, low + take, high))
        queue = moved
    return sorted(placed)


def assign(docs: DataFrame, shards: tuple[str, ...] = SHARDS, vnodes: int = VNODES, slack: float = SLACK, key: str = "doc_id") -> DataFrame:
    """(doc_id, shard, home): the shard of every row of docs, and the shard it would have with no bound.

    A key belongs to the first virtual node clockwise of its hash. No shard takes more than
    capacity() keys: keys that find a full shard go on clockwise to the next that has room,
    so that the bound holds whatever the hashes are, and only keys of overfull arcs move.
    Equal hashes are told apart by key; keys are ranked, and so shuffled, only in the arcs
    that overflow.

    A null key hashes as a key of its own. Repeated rows are placed one by one and count one
    each; they may part where a shard gets full between them. Other columns aren't read.
    """
    if not shards or len(set(shards)) != len(shards) or vnodes < 1 or slack < 0:
        raise ValueError("shards must be named apart, vnodes positive and slack not negative")
    spark = docs.sparkSession
    positions, owner = ring(shards, vnodes)
    nodes = len(owner)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                arc = np.searchsorted(positions, batch.column(1).to_numpy()) % nodes
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(arc.astype(np.int32))], ["id", "h", "arc"])

    keyed = docs.select(F.col(key).cast("long").alias("id")).select("id", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("h"))
    keyed = cut(keyed.mapInArrow(find, "id long, h long, arc int"))
    arcs = np.zeros(nodes, dtype=np.int64)
    for arc, n in keyed.groupBy("arc").count().collect():  # a row a virtual node
        arcs[arc] = n
    moves = flow(arcs, owner, capacity(int(arcs.sum()), len(shards), slack), len(shards))
    parts: dict[int, list[tuple[int, int]]] = {}
    for arc, _, high, shard in moves:
        parts.setdefault(arc, []).append((high, shard))
    whole = np.array([parts[a][0][1] if a in parts and len(parts[a]) == 1 else -1 for a in range(nodes)])
    split = {a: (np.array([h for h, _ in p]), np.array([s for _, s in p])) for a, p in parts.items() if len(p) > 1}
    names = pa.array(shards)
    shared = spark.sparkContext.broadcast((whole, split, owner))

    def name(batches: Iterator[pa.RecordBatch], ranked: bool) -> Iterator[pa.RecordBatch]:
        single, several, home = shared.value
        for batch in batches:
            arc = batch.column(1).to_numpy()
            to = single[arc]
            if ranked:
                rank = batch.column(2).to_numpy()
                for a in np.unique(arc).tolist():
                    mine = arc == a
                    high, shard = several[a]
                    to[mine] = shard[np.searchsorted(high, rank[mine])]
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(to)), names.take(pa.array(home[arc]))], ["doc_id", "shard", "home"])

    schema = "doc_id long, shard string, home string"
    over = sorted(split)
    if not over:
        return keyed.select("id", "arc").mapInArrow(lambda b: name(b, False), schema)
    apart = spark.createDataFrame([(a,) for a in over], "arc int")
    calm = keyed.join(F.broadcast(apart), "arc", "left_anti").select("id", "arc")
    order = Window.partitionBy("arc").orderBy("h", F.col("id").asc_nulls_first())
    full = keyed.join(F.broadcast(apart), "arc", "left_semi").select("id", "arc", F.row_number().over(order).cast("long").alias("rank"))
    return calm.mapInArrow(lambda b: name(b, False), schema).union(full.mapInArrow(lambda b: name(b, True), schema))
