"""A byte-level BPE tokenizer on the workers, by way of cached chunks.

Texts are cut at single spaces: the part from such a space up to the next is a chunk, one
or more whole pre-tokens whose ids don't depend on what stands around it. Ids of a text are
therefore those of its chunks in turn, and a chunk seen before needs no regex and no merge.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 150_000
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


@dataclass(frozen=True)
class Vocabulary:
    """The bytes of a rank file; they travel with the tasks, so that no worker needs the path."""

    ranks: bytes
    pattern: str = PATTERN

    @staticmethod
    def read(path: str = TOKENIZER, pattern: str = PATTERN) -> Vocabulary:
        return Vocabulary(Path(path).read_bytes(), pattern)

    @property
    def digest(self) -> str:
        return hashlib.sha1(self.ranks + self.pattern.encode()).hexdigest()


def ranks(v: Vocabulary) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, v.ranks.splitlines()) if a}


_encodings: dict[str, object] = {}


def encoding(v: Vocabulary):
    """The tiktoken encoding, built once in a process. Strings of special tokens are ordinary text."""
    if v.digest not in _encodings:
        import tiktoken

        _encodings[v.digest] = tiktoken.Encoding(v.digest, pat_str=v.pattern, mergeable_ranks=ranks(v), special_tokens={})
    return _encodings[v.digest]


def chunks(text: str) -> list[str]:
    """text cut at its lone spaces; all but the first have lost a leading space.

    A run of spaces may be one pre-token, so that a text with such runs is cut only at spaces
    that have no white space on either side.
    """
    return _LONE_SPACE.split(text) if "  " in text else text.split(" ")


class Cache(dict):
    """Chunk to what `make` gives for it with its leading space; emptied when it holds `most` of them.

    Entries of `kept` come back after that: the frequent ones, which are always at hand.
    """

    def __init__(self, make: Callable[[str], object], kept: dict[str, object] | None = None, most: int = CACHED):
        super().__init__(kept or {})
        self.make, self.kept, self.most = make, kept or {}, most + len(kept or {})

    def __missing__(self, chunk: str) -> object:
        if len(self) >= self.most:
            self.clear()
            self.update(self.kept)
        made = self[chunk] = self.make(" " + chunk)
        return made


_caches: dict[tuple, Cache] = {}


def cache(key: tuple, build: Callable[[], Cache]) -> Cache:
    """The process's cache of that key, so that tasks of one worker share it; a process holds one at a time."""
    if key not in _caches:
        _caches.clear()
        _caches[key] = build()
    return _caches[key]


@lru_cache(maxsize=2)
def id_bytes(v: Vocabulary) -> Callable[[str], bytes]:
    """Text to its ids as little-endian int32 bytes, with no Python object for an id."""
    encode = encoding(v).encode_to_numpy
    return lambda text: encode(text, disallowed_special=()).astype("<i4").tobytes()


def cached_id_bytes(v: Vocabulary) -> Callable[[str], bytes]:
    """id_bytes by the chunks of a text, from the process's cache."""
    encode = encoding(v).encode_ordinary

    def make(chunk: str) -> bytes:
        return np.array(encode(chunk), dtype="<i4").tobytes()

    get = cache(("ids", v.digest), lambda: Cache(make)).__getitem__

    def run(text: str) -> bytes:
        first, *rest = chunks(text)
        return make(first) + b"".join(map(get, rest))

    return run


_BLANK = r"\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def merged_sql(path: str = TOKENIZER) -> str:
    """DuckDB CTEs for the documents' pre-tokens and their merges, step by step from single bytes.

    cutup has a row a document (k, with its pre-tokens as l), every a row a pre-token (k, o, t),
    and merged the pre-tokens' pieces p in hexadecimal, where they are no longer open. Needs
    WITH RECURSIVE.
    """
    return rf"""ranks AS (SELECT hex(from_base64(split_part(line, ' ', 1))) AS h, CAST(split_part(line, ' ', 2) AS INTEGER) AS r FROM read_csv('{path}', columns = {{'line': 'VARCHAR'}}, header = false, delim = '\t', quote = '', escape = '') WHERE line <> ''),
    cutup AS (SELECT doc_id, source, text IS NULL AS void, row_number() OVER () AS k, regexp_extract_all(regexp_replace(text, '([{_BLANK}]+)([{_BLANK}][^{_BLANK}])', '\1' || chr(1) || '\2', 'g'),
      '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}\x01]+|[{_BLANK}]+') AS l FROM documents),
    every AS (SELECT k, unnest(range(len(l))) AS o, unnest(l) AS t FROM cutup),
    bits AS (SELECT t, list_transform(range(octet_length(encode(t))), lambda i: substr(hex(encode(t)), CAST(2 * i + 1 AS INTEGER), 2)) AS p FROM (SELECT DISTINCT t FROM every)),
    merged AS (
      SELECT t, p, true AS open FROM bits
      UNION ALL
      SELECT m.t, CASE WHEN b.o IS NULL THEN p ELSE list_concat(list_concat(p[:b.o - 1], [p[b.o] || p[b.o + 1]]), p[b.o + 2:]) END, b.o IS NOT NULL
      FROM merged m LEFT JOIN (SELECT t, min_by(o, (r, o)) AS o FROM (SELECT t, unnest(range(1, len(p))) AS o, unnest(list_transform(range(1, len(p)), lambda i: p[i] || p[i + 1])) AS h FROM merged WHERE open) x JOIN ranks USING (h) GROUP BY t) b ON b.t = m.t WHERE m.open)"""


def counted_sql(path: str = TOKENIZER) -> str:
    """DuckDB CTEs that end in counted (doc_id, source, n): the tokens of each document."""
    return f"""{merged_sql(path)},
    summed AS (SELECT k, CAST(sum(len(p)) AS BIGINT) AS n FROM every JOIN merged USING (t) WHERE NOT open GROUP BY k),
    counted AS (SELECT doc_id, source, CASE WHEN NOT void THEN coalesce(n, 0) END AS n FROM cutup LEFT JOIN summed USING (k))"""


def ids_sql(path: str = TOKENIZER) -> str:
    """(doc_id, n_tokens, token_ids) of the documents for DuckDB."""
    return f"""WITH RECURSIVE {merged_sql(path)},
    named AS (SELECT t, list(r ORDER BY i) AS ids FROM (SELECT t, unnest(range(len(p))) AS i, unnest(p) AS h FROM merged WHERE NOT open) x JOIN ranks USING (h) GROUP BY t),
    joined AS (SELECT k, flatten(list(ids ORDER BY o)) AS ids FROM every JOIN named USING (t) GROUP BY k)
    SELECT doc_id, CASE WHEN NOT void THEN CAST(coalesce(len(ids), 0) AS BIGINT) END AS n_tokens, CASE WHEN NOT void THEN coalesce(ids, []) END AS token_ids FROM cutup LEFT JOIN joined USING (k)"""
