"""Text functions of the Python workers, row by row, and how they become column functions.

They give what their namesakes of functions/text.py give, white space by Unicode's property,
which for Python's own functions also holds U+001C to U+001F.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_RUN = re.compile(f"[{SPACE}]+")
_ODD = re.compile("[\x1c-\x1f]")
_BLANK_LINES = re.compile(f"\n[{SPACE}]*\n+")
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound() -> None:
    """At most about BATCH_BYTES at a time go to a worker, unless the session has a bound of its own; a row is never cut."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def values(column: pa.Array) -> list:
    """The column's values; bytes that are no UTF-8 become U+FFFD, as in the JVM's functions."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        kind = pa.list_(pa.binary()) if pa.types.is_list(column.type) else pa.binary()

        def text(x):
            return [text(y) for y in x] if isinstance(x, list) else x if x is None else x.decode("utf-8", "replace")

        return [text(x) for x in column.cast(kind).to_pylist()]


def lifted(f: Callable, many: bool = True) -> Callable[[Column], Column]:
    """f of one value as a column function giving texts, or arrays of texts; null stays null."""
    kind = pa.list_(pa.string()) if many else pa.string()

    @F.arrow_udf("array<string>" if many else "string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([x if x is None else f(x) for x in values(column)], kind)

    bound()
    return run


def strip(text: str) -> str:
    return text.strip(SPACE)


def lines(text: str) -> list[str]:
    return [x for x in (y.strip(SPACE) for y in text.split("\n")) if x]


def words(text: str) -> list[str]:
    """Words of a stripped text; an empty one has none."""
    if _ODD.search(text):
        return [x for x in _RUN.split(text) if x]
    return text.split()


def tokens(text: str) -> list[str]:
    return words(text) if " " in text else list(text)


def flat(text: str) -> str:
    """The text's words joined by a blank."""
    return " ".join(words(text))


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of a stripped text: the last is the first that reaches the end."""
    parts, glue, step = tokens(text), " " if " " in text else "", size - overlap
    made = (strip(glue.join(parts[i * step : i * step + size])) for i in range(max(0, math.ceil((len(parts) - size) / step)) + 1))
    return [x for x in made if x]


def hybrid(text: str, size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    n, glue = 0, ""
    for line in lines(text):
        parts, by = tokens(line), " " if " " in line else ""
        if held and (len(parts) > size or n + len(parts) > size or glue != by):
            out.append(glue.join(held))
            held, n = [], 0
        if len(parts) > size:
            out += windows(line, size, overlap)
        else:
            held.append(" ".join(parts) if by else line)
            n, glue = n + len(parts), by
    if held:
        out.append(glue.join(held))
    return [x for x in map(strip, out) if x]


def by_line(text: str, size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    w = c = 0
    spaced = False
    for line in lines(text):
        n, here = len(words(line)), " " in line
        if (n if here else len(line)) > size:
            if held:
                out.append("\n".join(held))
            out += windows(line, size, overlap)
            held, w, c, spaced = [], 0, 0, False
        elif held and (w + n if spaced or here else c + 1 + len(line)) <= size:
            held.append(line)
            w, c, spaced = w + n, c + 1 + len(line), spaced or here
        else:
            if held:
                out.append("\n".join(held))
            held, w, c, spaced = [line], n, len(line), here
    return [*out, "\n".join(held)] if held else out


def by_paragraph(text: str, size: int, overlap: int) -> list[str]:
    whole = strip(text)
    parts = [x for x in map(strip, _BLANK_LINES.split(whole)) if x]
    return enforce_max(lines(whole) if len(parts) == 1 and "\n" in whole else parts, size, overlap)


def enforce_max(chunks: list[str | None], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    for x in (strip(y) for y in chunks if y is not None):
        if x:
            out += windows(x, size, overlap) if len(x) > size and len(tokens(x)) > size else [x]
    return out


def distinct(chunks: list[str | None]) -> list[str]:
    """Stripped texts without empty ones, each at its first place."""
    return list(dict.fromkeys(x for x in (strip(y) for y in chunks if y is not None) if x))
