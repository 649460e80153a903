"""Words and their hashes for Arrow string columns, without a Python object per row.

A word is a maximal run of ASCII letters and digits and of characters beyond ASCII; each
character from U+3000 to U+DFFF (kana, Han, Hangul) is a word of its own, as those scripts
don't put spaces between words. ASCII and Latin-1 capitals are folded. Offsets are bytes
of the UTF-8 text, or characters where asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from cairnkit.llm._util import give_back, mix

BLOCK_BYTES = 500_000
_PRIME = 0x100000001B3 * 0x9E3779B1 % (1 << 64) | 1
_WORD = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LONE = np.zeros(256, dtype=bool)
_LONE[0xE3:0xEE] = True
_powers: list[np.ndarray] = []


@dataclass
class Words:
    """The words of some rows: starts has each row's first word, and the end; raw and offsets are their bytes."""

    first: int
    rows: int
    hashes: np.ndarray
    starts: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    newline: np.ndarray | None
    gap: np.ndarray | None
    raw: np.ndarray
    offsets: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.starts))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = pow(_PRIME, -1, 1 << 64)
        pair = []
        for base in (_PRIME, inverse):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            pair.append(np.cumprod(x, dtype=np.uint64))
        if size > BLOCK_BYTES + 1:  # a giant text: not worth holding on to
            return pair[0], pair[1]
        _powers[:] = pair
    return _powers[0], _powers[1]


def blocks(texts: pa.Array, spans: bool = False) -> Iterator[Words]:
    """Words of runs of whole rows of about BLOCK_BYTES; a null has no words.

    begin and end are byte offsets within the row's text. With spans they are character
    offsets, and newline tells which words are the first of their line, gap which of them
    follow a line without words.
    """
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    valid = texts.is_valid().to_numpy(zero_copy_only=False) if texts.null_count else None
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1)
        last = min(last, n)
        yield _block(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, None if valid is None else valid[first:last], spans)
        first = last
    give_back()


def _block(raw: np.ndarray, offsets: np.ndarray, first: int, valid: np.ndarray | None, spans: bool) -> Words:
    rows = len(offsets) - 1
    inside = _WORD[raw]
    if valid is not None and not valid.all():
        for r in np.flatnonzero(~valid):
            inside[offsets[r] : offsets[r + 1]] = False
    opens = np.empty(len(raw), dtype=bool)
    if len(raw):
        opens[0] = True
        np.logical_not(inside[:-1], out=opens[1:])
        opens[offsets[:-1][offsets[:-1] < len(raw)]] = True
        opens |= _LONE[raw]
        opens &= inside
    folded = _FOLD[raw]
    latin = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
    folded[latin] += 0x20
    at = np.flatnonzero(inside)
    begin = np.flatnonzero(opens)
    if len(begin) == 0:
        none = np.zeros(0, np.int64)
        return Words(first, rows, np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), none, none, *[np.zeros(0, bool) if spans else None] * 2, raw, offsets)
    starts_in = np.flatnonzero(opens[at])
    power, inverse = _power(len(at) + 1)
    terms = folded[at].astype(np.uint64)
    terms += np.uint64(1)
    terms *= power[: len(at)]
    hashes = np.add.reduceat(terms, starts_in)
    hashes *= inverse[starts_in]
    mix(hashes)
    lengths = np.diff(np.append(starts_in, len(at)))
    starts = np.searchsorted(begin, offsets)
    owner = np.repeat(np.arange(rows), np.diff(starts))
    if not spans:
        begin = begin - offsets[:-1][owner]
        return Words(first, rows, hashes, starts, begin, begin + lengths, None, None, raw, offsets)
    line = np.cumsum(raw == 10)[begin]
    newline = np.ones(len(begin), dtype=bool)
    newline[1:] = line[1:] != line[:-1]
    gap = np.zeros(len(begin), dtype=bool)
    gap[1:] = line[1:] > line[:-1] + 1
    heads = starts[:-1][starts[:-1] < len(begin)]
    newline[heads], gap[heads] = True, False
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    base = before[offsets[:-1]][owner]
    return Words(first, rows, hashes, starts, before[begin] - base, before[begin + lengths] - base, newline, gap, raw, offsets)


#: SQL regular expression of a word, and the capitals that are folded with what they become.
_BEYOND = r"A-Za-z0-9\x{80}-\x{2FFF}\x{E000}-\x{10FFFF}"
WORD_SQL = rf"[\x{{3000}}-\x{{D7FF}}][{_BEYOND}]*|[{_BEYOND}]+"
CAPITALS = "".join(map(chr, [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]))


def runs(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, as they are."""
    power, inverse = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def shingles(hashes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word runs of the given size in each group, and where each group starts.

    A group of fewer words, but at least one, has one shingle made of all its words.
    """
    counts = np.diff(starts)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    group = np.repeat(np.arange(len(counts)), made)
    out_starts = np.concatenate(([0], np.cumsum(made)))
    at = starts[:-1][group] + (np.arange(len(group)) - out_starts[:-1][group])
    left = starts[1:][group] - at
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        factor = np.uint64((0xD6E8FEB86659FD93 * (2 * k + 3) + 2 * k) & (2**64 - 1) | 1)
        there = left > k
        if there.all():
            total += hashes[at + k] * factor
        else:
            total[there] += hashes[at[there] + k] * factor
    return mix(total), out_starts


def sequence_hashes(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each group's words in order; groups without words get 0."""
    counts = np.diff(starts)
    full = np.flatnonzero(counts > 0)
    out = [np.zeros(len(counts), dtype=np.uint64) for _ in range(2)]
    if len(full):
        power, inverse = _power(len(hashes) + 1)
        for k, salt in enumerate((0x2545F4914F6CDD1D, 0xD1342543DE82EF95)):
            terms = mix(hashes ^ np.uint64(salt))
            terms *= power[: len(terms)]
            total = np.add.reduceat(terms, starts[:-1][full])
            total *= inverse[starts[:-1][full]]
            total += counts[full].astype(np.uint64)
            out[k][full] = mix(total)
    return out[0], out[1]
