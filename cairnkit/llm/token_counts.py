"""Token counts of documents by a two-tier lookup on the map side."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnkit.llm._util import bounded, give_back
from cairnkit.llm import tokens
from cairnkit.llm.tokens import TOKENIZER, Cache, Vocabulary, chunks

TABLE = 1 << 16
SLICE = 500


def frequent(vocabulary: Vocabulary, table: int = TABLE) -> list[str]:
    """Up to `table` chunks that are frequent by the vocabulary's own account, the most frequent first.

    A byte-pair vocabulary is itself a ranking of a large corpus: its entries that begin with
    a space are the commonest pre-tokens, in the order of their ranks. They are taken as they
    stand, so that no pass over the texts and no shuffle is needed to find them. What is in
    the table only makes the lookup fast; counts of tokens don't depend on it.
    """
    found = []
    for raw, _ in sorted(tokens.ranks(vocabulary).items(), key=lambda e: e[1]):
        if raw[:1] == b" " and len(found) < table:
            try:
                chunk = raw[1:].decode()
            except UnicodeDecodeError:
                continue
            if " " not in chunk:
                found.append(chunk)
    return found


def compact(found: list[str], vocabulary: Vocabulary) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The frequent chunks as one string of bytes with their ends, and their lengths in tokens."""
    encode = tokens.encoding(vocabulary).encode_ordinary
    raw = [c.encode() for c in found]
    return b"".join(raw), np.cumsum([len(r) for r in raw], dtype=np.uint32), np.array([len(encode(" " + c)) for c in found], dtype=np.uint16)


def expand(packed: tuple[bytes, np.ndarray, np.ndarray]) -> dict[str, int]:
    raw, ends, lengths = packed
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
    return {raw[a:z].decode(): n for a, z, n in zip(begins.tolist(), ends.tolist(), lengths.tolist(), strict=True)}


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, table: int = TABLE, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_tokens, and the columns to keep), a row for each row of docs.

    n_tokens is exactly the number of ids that the tokenizer gives for the whole text, with
    special tokens taken as ordinary text. The lengths of frequent chunks come from a compact
    table of at most `table` entries that is broadcast; the others are encoded once in a
    worker and remembered in its cache of bounded size. One pass, no shuffle: the texts stay
    where they are read, and pre-tokens never leave their task.

    A null text has a null count, an empty text 0. Null doc_ids and repeated rows have a row
    each; an empty table gives none. doc_id must be a number, or text that is one. Columns
    other than doc_id, text and those to keep aren't read.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary.read(tokenizer)
    shared = spark.sparkContext.broadcast((vocabulary, compact(frequent(vocabulary, table), vocabulary)))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    names = ["doc_id", "n_tokens", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, frequent_lengths = shared.value
        encode = tokens.encoding(own).encode_ordinary
        key = ("lengths", own.digest, hash(frequent_lengths[0]))
        lengths = tokens.cache(key, lambda: Cache(lambda text: len(encode(text)), expand(frequent_lengths)))
        get = lengths.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                counts = []
                for text in part.column(1).to_pylist():
                    if text is None:
                        counts.append(None)
                    else:
                        first, *rest = chunks(text)
                        counts.append(len(encode(first)) + sum(map(get, rest)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), *part.columns[2:]], names)
        give_back()

    return bounded(slim).mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), *slim.schema.fields[2:]]))
