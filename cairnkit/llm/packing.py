"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnkit.llm._util import by_key, cut
from cairnkit.llm.mixing import word_count
from cairnkit.llm.orc_tokens import encode
from cairnkit.llm.tokens import TOKENIZER

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD, ATTENTION = 64.0, 1 / 32768
SHARD_PIECES = 20_000
SHARD_ID_PIECES = 4_096  # a task holds a shard's ids: 128 MB if all its pieces were of 8192
HOT = 1_000
SLICE = 500


def bin_cost(length: int) -> float:
    """What a sequence costs, in tokens: a fixed part, its length, and attention by the square."""
    return OVERHEAD + length + length * length * ATTENTION


def pack_sizes(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, its offset in the bin, length of each bin) for sizes in descending order.

    A piece goes to the open bin that it leaves least room in, the oldest of equals. Where
    none has room, a bin of the length is opened that costs least for a token it can hope
    to hold: the piece and whatever of the pieces to come would fit beside it, at most the
    length. In the end each bin is cut down to the least permitted length for its contents.
    """
    n = len(sizes)
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    used: list[int] = []
    caps: list[int] = []
    room: dict[int, list[int]] = {}
    rooms: list[int] = []
    tail = np.concatenate((np.cumsum(sizes[::-1], dtype=np.int64)[::-1], [0]))
    up = -sizes
    for i, size in enumerate(sizes.tolist()):
        k = bisect_left(rooms, size)
        if k < len(rooms):
            left = rooms[k]
            holders = room[left]
            at = holders.pop(0)
            if not holders:
                del room[left]
                rooms.pop(k)
        else:
            best = None
            for cap in lengths:
                if cap >= size:
                    rest = max(i + 1, int(np.searchsorted(up, size - cap)))
                    hope = min(cap, size + int(tail[rest])) if cap > size else size
                    price = bin_cost(cap) / hope
                    if best is None or price < best[0]:
                        best = (price, cap)
            at = len(used)
            used.append(0)
            caps.append(best[1])
            left = best[1]
        bins[i], offsets[i] = at, used[at]
        used[at] += size
        left -= size
        if left:
            if left in room:
                insort(room[left], at)
            else:
                room[left] = [at]
                insort(rooms, left)
    fits = np.searchsorted(np.array(lengths), np.array(used, dtype=np.int64))
    return bins, offsets, np.array(lengths, dtype=np.int64)[fits] if used else np.zeros(0, np.int64)


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, tokens_col: str | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(bin, bin_length, bin_tokens, offset, doc_id, piece, from_token, to_token), a row a piece.

    A document longer than the longest permitted length is first cut into pieces of that
    length and a rest; nothing is dropped. Pieces are spread over shards of about
    shard_pieces by a hash of doc_id, piece and size, and each shard is packed by itself with
    pack_sizes; the loss against one packing of all is at most a few open bins a shard. Where
    more than shard_pieces pieces are alike in all three, as null ids may be, their shards
    are drawn row by row.

    Null texts, and texts without tokens, hold nothing to pack and have no row; an empty
    table gives none. Null ids and repeated rows are packed as documents of their own. Tokens
    are words, unless tokens_col names a column of counts. Only doc_id and text (or
    tokens_col) are read.
    """
    lengths = _checked(lengths)
    most = lengths[-1]
    measure = F.col(tokens_col).cast("long") if tokens_col else word_count(F.col("text"))
    slim = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), measure.alias("n")).where("n > 0"))
    pieces = slim.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1), F.lit(most).cast("long"))).alias("piece", "from_token"))
    pieces = pieces.select("doc_id", "piece", "from_token", F.least(F.col("n") - F.col("from_token"), F.lit(most)).alias("size"))
    total = slim.agg(F.sum(F.ceil(F.col("n") / most))).first()[0] or 0
    return _packed(_sharded(pieces, "n", slim, total, shard_pieces), lengths, None)


def pack_ids(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, tokenizer: str = TOKENIZER, shard_pieces: int = SHARD_ID_PIECES) -> DataFrame:
    """pack() by the tokenizer's tokens, with each piece's token_ids as a last column.

    A sequence is the token_ids of a bin's rows in the order of offset, filled up to
    bin_length. Texts are encoded once, where they are read, and their ids shuffled once, to
    the shard that packs them; the number of shards comes from the texts' bytes, of which a
    token has at least one. Rows have the same results as in pack(); where more than
    shard_pieces rows share doc_id and text, their shards are drawn row by row.
    """
    lengths = _checked(lengths)
    most = lengths[-1]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and text <> ''")
    total = slim.agg(F.sum(F.ceil(F.octet_length("text") / most))).first()[0] or 0

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(bounds)
            parts = -(-sizes // most)
            row = np.repeat(np.arange(len(sizes)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = bounds[row] + piece * most
            size = np.minimum(bounds[row + 1] - begin, most)
            ids = pa.ListArray.from_arrays(pa.array(np.append(begin, begin[-1] + size[-1]).astype(np.int32) if len(row) else np.zeros(1, np.int32)), lists.values)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * most), pa.array(size), ids], ["doc_id", "piece", "from_token", "size", "token_ids"])

    pieces = encode(slim, tokenizer, cached=True).mapInArrow(split, "doc_id long, piece int, from_token long, size long, token_ids array<int>")
    pieces = pieces.withColumn("n", F.xxhash64("token_ids"))
    return _packed(_sharded(pieces, "n", slim.select("doc_id", F.xxhash64("text").alias("n")), total, shard_pieces), lengths, "token_ids")


def _checked(lengths: tuple[int, ...]) -> tuple[int, ...]:
    lengths = tuple(sorted(set(lengths)))
    if not lengths or lengths[0] < 1:
        raise ValueError("lengths must be positive")
    return lengths


def _sharded(pieces: DataFrame, like: str, rows: DataFrame, total: int, shard_pieces: int) -> DataFrame:
    """pieces with a shard, by doc_id, piece and size, and drawn where rows hold too many of one doc_id and `like`."""
    shards = max(1, -(-total // shard_pieces))
    salt = F.lit(0).cast("long")
    if shards > 1:
        many = [r[0] for r in rows.groupBy("doc_id", like).count().where(F.col("count") > shard_pieces).select("doc_id").distinct().limit(HOT + 1).collect()]
        if len(many) > HOT:
            salt = F.monotonically_increasing_id()
        elif many:
            hot = F.col("doc_id").isin([m for m in many if m is not None]) | (F.col("doc_id").isNull() if None in many else F.lit(False))
            salt = F.when(hot, F.monotonically_increasing_id()).otherwise(salt)
    parts = ["doc_id", "piece", "size", *(["n"] if "n" in pieces.columns else [])]
    return pieces.withColumn("shard", F.pmod(F.xxhash64(*parts, salt), F.lit(shards)).cast("long"))


def _packed(pieces: DataFrame, lengths: tuple[int, ...], ids: str | None) -> DataFrame:
    extra = [ids] if ids else []
    ordered = pieces.select("shard", "size", "doc_id", "piece", "from_token", *extra).repartition("shard").sortWithinPartitions("shard", F.desc("size"), "doc_id", "piece", "from_token", *[F.xxhash64(c) for c in extra])
    names = ["bin", "bin_length", "bin_tokens", "offset", "doc_id", "piece", "from_token", "to_token", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in by_key(batches, "shard"):
            sizes, first = table.column("size").to_numpy(), table.column("from_token").to_numpy()
            shard = table.column("shard").to_numpy()
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                bins, offsets, caps = pack_sizes(sizes[s:e], lengths)
                tokens = np.bincount(bins, weights=sizes[s:e], minlength=len(caps)).astype(np.int64)
                part = table.slice(s, e - s)
                columns = [pa.array((shard[s] << 32) + bins), pa.array(caps[bins]), pa.array(tokens[bins]), pa.array(offsets), *[_flat(part.column(c)) for c in ("doc_id", "piece", "from_token")], pa.array(first[s:e] + sizes[s:e]), *[_flat(part.column(c)) for c in extra]]
                made = pa.RecordBatch.from_arrays(columns, names)
                for at in range(0, e - s, SLICE if extra else e - s):
                    yield made.slice(at, SLICE if extra else e - s)

    schema = "bin long, bin_length long, bin_tokens long, offset long, doc_id long, piece int, from_token long, to_token long" + (", token_ids array<int>" if ids else "")
    return ordered.mapInArrow(run, schema)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
