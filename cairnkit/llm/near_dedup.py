"""Near-duplicate documents by SuperMinHash, banding, verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnkit.llm import _words, superminhash
from cairnkit.llm._util import bounded, by_key, cut, fresh, int64s, linked, mix, signed, small, without
from cairnkit.llm.components import components

SHINGLE = 3
BANDS, ROWS = 40, 4
THRESHOLD, SLACK = 0.5, 0.04


def collisions(keys: DataFrame) -> DataFrame:
    """(bucket, item): the item sets of two or more that share a key, each set once.

    keys has (key, item), bigints without nulls. One shuffle by key, sorted on the JVM; an
    item that is repeated under a key counts once. bucket is a hash of the set's items, so
    that sets which many bands bring about are told once by the second, far smaller, shuffle.
    """
    sorted_keys = keys.repartition("key").sortWithinPartitions("key", "item")
    return sorted_keys.mapInArrow(_collided, "bucket long, item long").distinct()


def collided(pairs: DataFrame) -> DataFrame:
    """(h1) of the items of collisions(); broadcast as far as they are few, so that the others' rows aren't shuffled."""
    return small(cut(pairs.select(F.col("item").alias("h1")).distinct()))


def _collided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, starts in by_key(batches, "key"):
        item = table.column("item").to_numpy()
        run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        new = np.ones(len(item), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (run[1:] != run[:-1])
        item, run = item[new], run[new]
        many = np.bincount(run, minlength=len(starts) - 1)[run] > 1
        item, run = item[many], run[many]
        if len(item):
            opens = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            bucket = np.add.reduceat(mix(item.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)), opens)
            bucket = np.repeat(bucket, np.diff(np.append(opens, len(item))))
            yield pa.RecordBatch.from_arrays([pa.array(signed(mix(bucket))), pa.array(item)], ["bucket", "item"])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, slack: float = SLACK, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id) of the documents that have a near duplicate; group_id is the least doc_id.

    A document is the set of its runs of `shingle` words. Two documents are linked when they
    share a band and their signatures of bands * rows slots agree in at least `threshold -
    slack` of the slots; the agreement estimates their Jaccard similarity with a deviation
    below 0.04, so that the slack keeps pairs which lie at the threshold. Groups are
    connected components.
    At the defaults a pair at similarity 0.5 shares a band with probability 0.92, one at 0.6
    with 0.996. Documents of the same words in the same order are one item from the start,
    so that thousands of copies cost as much as one.

    Rows with a null id, and null texts or texts without words, are in no group. Rows that
    repeat an id are one document, linked to whatever any of them is linked to; an id only
    repeated forms no group. Other columns aren't read.
    """
    signed_docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    slots = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for w in _words.blocks(batch.column(1)):
                items, starts = _words.shingles(w.hashes, w.starts, shingle)
                sig = superminhash.signatures(items, starts, slots)
                one, two = _words.sequence_hashes(w.hashes, w.starts)
                full = np.flatnonzero(np.diff(starts) > 0)
                if len(full):
                    packed = pa.Array.from_buffers(pa.binary(slots * 4), len(full), [None, pa.py_buffer(np.ascontiguousarray(sig[full]))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([ids.slice(w.first, w.rows).take(pa.array(full)), pa.array(signed(one[full])), pa.array(signed(two[full])), packed], ["id", "h1", "h2", "sig"])

    table = cut(bounded(signed_docs).mapInArrow(sign, "id long, h1 long, h2 long, sig binary"))

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1 = np.unique(int64s(batch.column(0)), return_index=True)
            if len(h1[0]):
                keys = superminhash.band_keys(_slots(batch.column(1), slots)[h1[1]], bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(h1[0], bands))], ["key", "item"])

    pairs = cut(collisions(table.select("h1", "sig").mapInArrow(band, "key long, item long")))
    # a collided item's signature comes once for each (h1, h2): copies were one item so far
    known = table.join(collided(pairs), "h1", "left_semi").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
    shipped = pairs.join(known, pairs["item"] == known["h1"]).select("bucket", "id", "sig").repartition("bucket").sortWithinPartitions("bucket", "id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = (threshold - slack) * slots - 1e-9
        for t, starts in by_key(batches, "bucket"):
            ids, sig = t.column("id").to_numpy(), _slots(t.column("sig").combine_chunks(), slots)
            sizes = np.diff(starts)
            two = starts[:-1][sizes == 2]
            hit = two[(sig[two] == sig[two + 1]).sum(axis=1) >= need]
            a, b = [ids[hit]], [ids[hit + 1]]
            for s, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                part = sig[s : s + n]
                forest = linked(n, lambda i, rest, part=part: (part[rest] == part[i]).sum(axis=1) >= need)
                if forest:
                    x = np.array(forest) + s
                    a.append(ids[x[:, 0]])
                    b.append(ids[x[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    same = table.select(F.col("id").alias("b"), F.min("id").over(Window.partitionBy("h1", "h2")).alias("a")).where("a <> b").select("a", "b")
    found = components(shipped.mapInArrow(verify, "a long, b long").union(same))
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))


def _slots(column: pa.Array, slots: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    fixed = column.cast(pa.binary(slots * 4))
    return np.frombuffer(fixed.buffers()[1], dtype=np.uint32)[fixed.offset * slots : (fixed.offset + len(fixed)) * slots].reshape(-1, slots)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the least doc_id of each near-duplicate group, columns as they were.

    Documents in no group stay, those with null ids, null texts or no words included. Rows
    that repeat a doc_id are cut to one, the least by all columns' text form; rows with a
    null doc_id are left as they are.
    """
    groups = cut(near_duplicates(docs, **options))
    kept = without(docs, groups.where("doc_id <> group_id").select("doc_id"))
    name, row = fresh(docs, "id"), fresh(docs, "row")
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(name)).count().where("count > 1").select(name)
    if again.isEmpty():
        return kept
    once = kept.join(again, kept["doc_id"] == again[name], "left_anti")
    twice = kept.join(again, kept["doc_id"] == again[name], "left_semi")
    whole = F.struct(*[twice[c] for c in docs.columns])
    ranked = twice.groupBy(F.col("doc_id").alias(name)).agg(F.min_by(whole, F.to_json(whole)).alias(row))
    return once.unionByName(ranked.select(*[F.col(row).getField(c).alias(c) for c in docs.columns]))
