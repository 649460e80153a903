"""Token ids in ORC files: run-length coded stripes with row indexes and Bloom filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnkit.llm._util import bounded, give_back
from cairnkit.llm import tokens
from cairnkit.llm.tokens import TOKENIZER, Vocabulary

STRIPE_BYTES = 64 << 20
INDEX_ROWS = 1_000
FALSE_POSITIVES = 0.01
SLICE = 500


def id_lists(texts: pa.Array, make: Callable[[str], bytes]) -> tuple[pa.Array, pa.Array]:
    """How many ids each text has, and the ids, by one call of make for a text; nulls stay null.

    The encoder takes less for a whole text than a cache for its chunks where many are rare.
    """
    found = [b"" if text is None else make(text) for text in texts.to_pylist()]
    ends = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found]))).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
    empty = texts.is_null()
    lists = pa.ListArray.from_arrays(pa.array(ends), values, mask=empty if texts.null_count else None)
    return pa.array(np.diff(ends).astype(np.int64), mask=empty.to_numpy(zero_copy_only=False)), lists


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, cached: bool = False) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every row of docs.

    token_ids are those of the whole text, special tokens taken as ordinary text. A null text
    has null ids and a null n_tokens, an empty text an empty array. Null doc_ids and repeated
    rows have a row each. Only doc_id and text are read. With cached, ids come from a worker's
    cache of chunks; they are the same.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = (tokens.cached_id_bytes if cached else tokens.id_bytes)(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), *id_lists(part.column(1), make)], ["doc_id", "n_tokens", "token_ids"])
        give_back()

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>")


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, stripe_bytes: int = STRIPE_BYTES, index_rows: int = INDEX_ROWS) -> None:
    """Write encode(docs) to ORC at path, which must not exist yet.

    Each task writes its own rows, sorted by doc_id so that the row indexes, one entry for
    index_rows rows, tell narrow ranges of ids; no shuffle. Stripes are independent: a reader
    takes them in parallel. doc_id has Bloom filters beside its minima and maxima. Integers
    are stored in ORC's second run-length coding, which bit-packs ids to what they need, and
    not compressed beyond that.
    """
    ids = encode(docs, tokenizer).sortWithinPartitions("doc_id")
    options = {"orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_rows, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_POSITIVES, "orc.write.format": "0.12", "compression": "none"}
    ids.write.options(**options).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of what write() wrote, or of those ids alone.

    With doc_ids the filter reaches the files: stripes and row groups whose ranges or Bloom
    filters exclude all of them aren't read.
    """
    found = spark.read.schema("doc_id long, n_tokens long, token_ids array<int>").orc(path)
    return found if doc_ids is None else found.where(F.col("doc_id").isin(doc_ids))
