"""Exact nearest neighbours of a query set among all vectors, by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnkit.llm._util import cut

K = 10
EVERY = 50
PIVOTS = 32
POOL = 1024
BLOCK = 2048
FIRST = 64
STEP = 4
DENSE = 8  # a product is taken where one in so many of its cells is wanted
AT_ONCE = 32_768  # queries in a broadcast: 40 MB at 64 places, 32 pivots and 10 neighbours
_HUGE = 1e150
_SLACK = 1e-9
_NEAR = 1e-6  # more than distances() may be off by, of the vectors' length
_PAIRS = 1 << 17


def choose_pivots(pool: np.ndarray, pivots: int) -> np.ndarray:
    """Vectors of the pool far from each other: each is the farthest from those before it."""
    if not len(pool):
        return pool
    chosen, away = [0], np.linalg.norm(pool - pool[0], axis=1)
    while len(chosen) < min(pivots, len(pool)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(pool - pool[chosen[-1]], axis=1))
    return pool[chosen]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All Euclidean distances, by one matrix product: to about 1e-7 of the vectors' length, for use with slack()."""
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def slack(x: np.ndarray, y: np.ndarray) -> float:
    """More than distances(x, y) may be off by."""
    return _NEAR * (1 + float(np.sqrt(max((x * x).sum(axis=1).max(), (y * y).sum(axis=1).max()))))


class Nearest:
    """The k nearest found so far for some queries; equal distances go by id."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.ids, self.k = queries, ids, k
        self.distance = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)

    @property
    def limit(self) -> np.ndarray:
        return self.distance[:, -1]

    def offer(self, query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """Evaluate the pairs (query[i], at[i]) and keep what is nearer; pairs of a query are together."""
        other = self.ids[query] != ids[at]
        query, at = query[other], at[other]
        for begin in range(0, len(query), _PAIRS):
            self._offer(query[begin : begin + _PAIRS], vectors, ids, at[begin : begin + _PAIRS])

    def _offer(self, query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        d = np.sqrt(((self.queries[query] - vectors[at]) ** 2).sum(axis=1))
        near = d <= self.limit[query]
        query, d, new = query[near], d[near], ids[at[near]]
        if not len(query):
            return
        mine = np.unique(query)
        every = np.concatenate([query, np.repeat(mine, self.k)])
        d, new = np.concatenate([d, self.distance[mine].ravel()]), np.concatenate([new, self.found[mine].ravel()])
        order = np.lexsort((new, d, every))
        every, d, new = every[order], d[order], new[order]
        start = np.searchsorted(every, mine)
        pick = start[:, None] + np.arange(self.k)
        self.distance[mine], self.found[mine] = d[pick], new[pick]


def search_block(near: Nearest, pivot_q: np.ndarray, vectors: np.ndarray, ids: np.ndarray, pivot_x: np.ndarray, among: np.ndarray | None = None) -> int:
    """Offer the vectors of one block to the queries (or those `among` them); how many distances were evaluated.

    The bound of a pair is the greatest difference of their distances to a pivot. Queries
    that the block's ranges of these distances exclude are left out first. The others take
    their candidates in the order of bounds, FIRST of them and then four times as many in
    each further round (all that are open, once the queries want much the same ones), and
    stop where the next bound is beyond the limit as lowered so far.
    """
    low, high = pivot_x.min(axis=0), pivot_x.max(axis=0)
    gap = np.maximum(low - pivot_q, pivot_q - high).max(axis=1)
    active = np.flatnonzero(gap <= near.limit + _SLACK)
    if among is not None:
        active = np.intersect1d(active, among)
    step, evaluated = max(1, (1 << 21) // len(ids)), 0
    for begin in range(0, len(active), step):
        some = active[begin : begin + step]
        bound = _bounds(pivot_q[some], pivot_x, near.limit[some])
        size = FIRST
        while True:
            open_pairs = bound <= near.limit[some, None] + _SLACK
            if not open_pairs.any():
                break
            wanted = open_pairs
            if size < len(ids):
                wanted = open_pairs & (bound <= np.partition(bound, size - 1, axis=1)[:, size - 1][:, None])
                if _dense(wanted):
                    wanted = open_pairs  # a product of these rows and columns would hold them too
            evaluated += _evaluate(near, some, wanted, vectors, ids)
            if wanted is open_pairs:
                break
            bound[wanted] = np.inf  # done with
            size *= 4
    return evaluated


def _dense(wanted: np.ndarray) -> bool:
    return int(wanted.sum()) * DENSE >= int(wanted.any(axis=1).sum()) * int(wanted.any(axis=0).sum())


def _evaluate(near: Nearest, some: np.ndarray, wanted: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> int:
    """Offer the wanted (query, vector) pairs: one by one where they are few, else by a product of their rows and columns."""
    if not _dense(wanted):
        q, x = np.nonzero(wanted)
        near.offer(some[q], vectors, ids, x)
        return len(q)
    rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    at, open_pairs = some[rows], wanted[np.ix_(rows, columns)]
    about = distances(near.queries[at], vectors[columns])
    off = slack(near.queries[at], vectors[columns])
    near_enough = _kth(np.where(open_pairs, about, np.inf), near.k, near.limit[at])
    q, x = np.nonzero(open_pairs & (about <= near_enough[:, None] + 2 * off))
    near.offer(at[q], vectors, ids, columns[x])
    return len(rows) * len(columns)


def _kth(about: np.ndarray, k: int, limit: np.ndarray) -> np.ndarray:
    """The lesser of each query's limit and its (k + 1)-th approximate distance (one may be its own)."""
    if about.shape[1] <= k + 1:
        return limit
    return np.minimum(limit, np.partition(about, k, axis=1)[:, k])


def _bounds(pivot_q: np.ndarray, pivot_x: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Each pair's greatest difference of distances to a pivot, raised pivot by pivot.

    It ends early where STEP more pivots exclude less than a tenth of the pairs left: bounds
    from fewer pivots are lower, and so never exclude a pair wrongly.
    """
    bound = np.zeros((len(pivot_q), len(pivot_x)))
    left = bound.size
    for at in range(0, pivot_x.shape[1], STEP):
        for p in range(at, min(at + STEP, pivot_x.shape[1])):
            np.maximum(bound, np.abs(pivot_q[:, p, None] - pivot_x[None, :, p]), out=bound)
        now = int((bound <= limit[:, None] + _SLACK).sum())
        if now > 0.9 * left or not now:
            break
        left = now
    return bound


def top_k(table: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", at_once: int = AT_ONCE) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the k nearest other vectors of every query, exactly.

    The queries are the vectors whose id is divisible by `every`; 1 makes all of them
    queries. Each is held against every row. Distances are Euclidean, in double precision;
    equal ones are ranked by neighbor_id. For unit vectors the order is that of cosine
    similarity. Where fewer than k other vectors exist, all are returned.

    Each vector's distances to the pivots are its row of the pivot table. Vectors are put in
    order by nearest pivot and distance to it and cut into blocks, once. A query first
    searches the block that it lies in, which limits how far its neighbours can be. Queries
    then travel to the blocks, at most at_once vectors in one broadcast, and each task passes
    on only what is nearer than that limit; blocks, and candidates within them, are left out
    where their bounds exceed the limit, and never for another reason. Vectors are shuffled
    once, for their order, whatever the number of queries.

    Rows with a null id, a null vector or a component that is null, NaN or of 1e150 or more
    (whose square is no number) are left out, as are vectors not of the most frequent length
    (the least of equally frequent). Of rows that repeat an id the least vector counts. An
    empty table, or one without queries, gives no rows. Other columns aren't read.
    """
    if k < 1 or every < 1 or pivots < 1 or block < 2 or at_once < 1:
        raise ValueError("k, every, pivots and at_once must be positive, block 2 or more")
    spark = table.sparkSession
    clean = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    clean = clean.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(_HUGE))))
    sizes = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "vec_id long, rank int, neighbor_id long, distance double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes.n
    clean = cut(clean.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")))
    pool = clean.orderBy(F.xxhash64("id"), "id").limit(POOL).collect()  # of fixed size: candidates for pivots
    points = choose_pivots(np.array([r.v for r in pool]), pivots)
    shared = spark.sparkContext.broadcast(points)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(_matrix(batch.column(1), dim), shared.value)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["id", "v", "pivot", "far"])

    ordered = clean.mapInArrow(measure, "id long, v array<double>, pivot int, far double").repartitionByRange("pivot", "far", "id").sortWithinPartitions("pivot", "far", "id")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), _matrix(batch.column(1), dim)))
            while sum(len(i) for i, _ in held) >= 2 * block:
                ids, x = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                held = [(ids[block:], x[block:])]
                yield _pack(ids[:block], x[:block], shared.value)
        if held and sum(len(i) for i, _ in held):
            yield _pack(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), shared.value)

    blocks = cut(ordered.mapInArrow(gather, "block long, ids binary, vectors binary, table binary"))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, x, t in _unpacked(batches, dim):
            mine = np.flatnonzero(ids % every == 0)
            if len(mine):
                near = Nearest(x[mine], ids[mine], k)
                search_block(near, t[mine], x, ids, t)
                parts = (ids[mine], x[mine], t[mine], near.distance, near.found)
                yield pa.RecordBatch.from_arrays([pa.array([name]), *[pa.array([np.ascontiguousarray(p).tobytes()]) for p in parts]], ["block", "ids", "vectors", "table", "distance", "found"])

    asked = cut(blocks.mapInArrow(at_home, "block long, ids binary, vectors binary, table binary, distance binary, found binary"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = np.frombuffer(row["distance"]).reshape(-1, k)
                there = np.isfinite(d)
                yield _result(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["found"], np.int64).reshape(-1, k), d, there)

    found = asked.mapInArrow(first, "vec_id long, neighbor_id long, distance double")
    for homes, queries, pivot_q, distance, seeds in _in_turn(asked, dim, k, at_once):
        sent = spark.sparkContext.broadcast((homes, queries, pivot_q, distance, seeds))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            homes, (own, vectors), pivot_q, distance, seeds = sent.value
            near = Nearest(vectors, own, k)
            near.distance, near.found = distance.copy(), seeds.copy()
            for name, ids, x, t in _unpacked(batches, dim):
                search_block(near, pivot_q, x, ids, t, np.flatnonzero(homes != name))
            new = np.isfinite(near.distance) & ~(near.found[:, :, None] == seeds[:, None, :]).any(axis=2)
            if new.any():
                yield _result(own, near.found, near.distance, new)

        found = found.union(cut(blocks.select("block", "ids", "vectors", "table").mapInArrow(search, "vec_id long, neighbor_id long, distance double")))
    best = Window.partitionBy("vec_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", "distance")


def _in_turn(asked: DataFrame, dim: int, k: int, at_once: int) -> Iterator[tuple]:
    """The queries in runs of at most at_once (and a block's), read one partition at a time."""
    held, count = [], 0
    for row in asked.toLocalIterator():
        ids = np.frombuffer(row.ids, np.int64)
        if held and count + len(ids) > at_once:
            yield _run(held)
            held, count = [], 0
        held.append((np.full(len(ids), row.block), ids, np.frombuffer(row.vectors).reshape(len(ids), dim), np.frombuffer(row.table).reshape(len(ids), -1), np.frombuffer(row.distance).reshape(-1, k), np.frombuffer(row.found, np.int64).reshape(-1, k)))
        count += len(ids)
    if held:
        yield _run(held)


def _run(held: list[tuple]) -> tuple:
    homes, ids, vectors, tables, distance, found = (np.concatenate(x) for x in zip(*held, strict=True))
    return homes, (ids, vectors), tables, distance, found


def _unpacked(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = np.frombuffer(batch.column(1)[i].as_buffer(), dtype=np.int64)
            x, t = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.float64).reshape(len(ids), -1) for c in (2, 3))
            yield batch.column(0)[i].as_py(), ids, x, t


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _pack(ids: np.ndarray, x: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
    """A block as one row, named by its least id: each id is in one block."""
    t = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in points], axis=1)
    parts = (ids, np.ascontiguousarray(x), np.ascontiguousarray(t))
    return pa.RecordBatch.from_arrays([pa.array([int(ids.min())]), *[pa.array([p.tobytes()]) for p in parts]], ["block", "ids", "vectors", "table"])


def _result(ids: np.ndarray, found: np.ndarray, distance: np.ndarray, these: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[np.nonzero(these)[0]]), pa.array(found[these]), pa.array(distance[these])], ["vec_id", "neighbor_id", "distance"])


def top_k_sql(k: int = K, every: int = EVERY) -> str:
    """top_k() over the embeddings table for DuckDB, comparing each query with all rows."""
    return f"""WITH e AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY vec_id),
    d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbor_id) AS rank FROM d)
    SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(dist, 6) AS distance FROM r WHERE rank <= {k}"""
