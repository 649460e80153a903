"""Cleaning operators: each maps a text column to a text column; null stays null."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnkit.functions import worker

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
_SPACES = "　   " + "".join(map(chr, range(0x2000, 0x200B)))
_TO_NARROW = str.maketrans(_WIDE, _NARROW)
_ANY_WIDE, _ANY_SPACE = re.compile(f"[{_WIDE[0]}-{_WIDE[-1]}]"), re.compile(f"[{_SPACES}]")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_BLANKS, _INNER_BLANKS = re.compile("[ \t]{2,}"), re.compile("(?<=[^ \t\n\x0b\x0c\r])[ \t]{2,}")


def _basic(t: str) -> str:
    t = _CONTROL.sub("", t.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"))
    return "\n".join(worker.lines(t))


def _spaces(t: str) -> str:
    return t if t.isascii() else _ANY_SPACE.sub(" ", t)


def _narrow(t: str) -> str:
    return t.translate(_TO_NARROW) if not t.isascii() and _ANY_WIDE.search(t) else t


def _compose(t: str) -> str:
    return t if t.isascii() else unicodedata.normalize("NFC", t)


def _rstrip_lines(t: str) -> str:
    return "\n".join([x.rstrip(worker.SPACE) for x in t.split("\n")])


def _squeeze(t: str) -> str:
    if "  " in t or "\t" in t:
        t = _BLANKS.sub(" ", t)
    return worker.strip(_rstrip_lines(t))


def _normal(t: str, code: bool) -> str:
    t = _spaces(t)
    return _squeeze(_compose(t if code else _narrow(t)))


def _code(t: str) -> str:
    return worker.strip(_rstrip_lines(t))


def _markdown(t: str) -> str:
    return re.sub("\n{3,}", "\n\n", _code(re.sub("(?s)<!--.*?-->", "", t)))


def _indented(t: str) -> str:
    plain = _CONTROL.sub("", t.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"))
    return _rstrip_lines(_INNER_BLANKS.sub(" ", _compose(_spaces(plain)))).strip("\n")


def _clean(t: str, kind: str | None, preserve_indent: bool) -> str:
    if kind == "code" and preserve_indent:
        return _indented(t)
    body = _normal(_basic(t), kind == "code")
    return _markdown(body) if kind == "markdown" else _code(body) if kind == "code" else body


def _text(f: Callable[[str], str], column: Column) -> Column:
    return worker.lifted(f, many=False)(column)


def basic_clean(text: Column) -> Column:
    """No byte-order mark, one kind of line end, no control characters, stripped lines without blanks."""
    return _text(_basic, text)


def map_fullwidth(text: Column) -> Column:
    return F.translate(text, _WIDE, _NARROW)


def map_spaces(text: Column) -> Column:
    return F.translate(text, _SPACES, " " * len(_SPACES))


def nfc(text: Column) -> Column:
    """Canonical composition."""
    return _text(_compose, text)


def normalize_prose(text: Column) -> Column:
    return _text(lambda t: _normal(t, False), text)


def normalize_code(text: Column) -> Column:
    return _text(lambda t: _normal(t, True), text)


def normalize_text(text: Column, for_code: bool = False) -> Column:
    return normalize_code(text) if for_code else normalize_prose(text)


def _by_type(f: Callable[[str, str | None], str], text: Column, file_type: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        return pa.array([t if t is None else f(t, k) for t, k in zip(worker.values(texts), kinds.to_pylist(), strict=True)], pa.string())

    worker.bound()
    return run(text, file_type)


def normalize_for_type(text: Column, file_type: Column) -> Column:
    """Code keeps its full-width characters; the rest of the treatment is shared."""
    return _by_type(lambda t, kind: _normal(t, kind == "code"), text, file_type)


def clean_markdown(text: Column) -> Column:
    return _text(_markdown, text)


def clean_code(text: Column) -> Column:
    return _text(_code, text)


def clean_text(text: Column, file_type: Column, preserve_indent: bool = False) -> Column:
    """The whole chain of a document that isn't paged; with preserve_indent code keeps its lines' indents."""
    return _by_type(lambda t, kind: _clean(t, kind, preserve_indent), text, file_type)


def clean_pages(pages: DataFrame, min_line: int = 3, max_line: int = 200, ratio: float = 0.65, normalize: bool = True) -> DataFrame:
    """(doc_id, text) of paged documents (doc_id, page_no, page_text), without repeated edge lines.

    A page's first line goes from all pages if it is the most common first line (the earliest
    of equals) of at least max(2, ceil(ratio * pages)) non-blank pages and has min_line to
    max_line characters; then the same for last lines. On each page the first (or last) line
    that equals it goes, wherever it stands. Pages are joined by a blank line; a document
    without a page that isn't blank has an empty text. Null pages are blank.
    """
    ratio = min(1.0, max(0.0, ratio))

    @F.arrow_udf("string")
    def run(documents: pa.Array, known: pa.Array) -> pa.Array:
        found = [_without_edges(d, k, min_line, max_line, ratio) for d, k in zip(documents.to_pylist(), known.to_pylist(), strict=True)]
        return pa.array([_normal(t, False) if normalize else t for t in found], pa.string())

    worker.bound()
    page = F.struct("page_no", F.coalesce("page_text", F.lit("")).alias("text"))
    whole = pages.select("doc_id", page.alias("page")).groupBy("doc_id").agg(F.collect_list("page").alias("pages"))
    return whole.select("doc_id", run(F.col("pages"), F.col("doc_id").isNotNull()).alias("text"))


def _without_edges(pages: list[dict], known: bool, min_line: int, max_line: int, ratio: float) -> str:
    """The joined pages of a document; one whose id isn't known keeps its edges."""
    rows = [(p["page_no"], worker.strip(p["text"]).split("\n")) for p in pages]
    for last in (False, True) if known else ():
        edges: dict[str, tuple[int, list]] = {}
        for no, texts in rows:
            solid = next((x for x in map(worker.strip, reversed(texts) if last else texts) if x), None)
            if solid is not None:
                n, at = edges.get(solid, (0, []))
                edges[solid] = n + 1, at if no is None else [min([*at, no])]
        total = sum(n for n, _ in edges.values())
        if total < 2:
            continue
        gone = min(edges, key=lambda x: (-edges[x][0], edges[x][1], x))
        if edges[gone][0] < max(2, math.ceil(ratio * total - math.ulp(1.0))) or not min_line <= len(gone) <= max_line:
            continue
        for _, texts in rows:
            at = next((i for i in (range(len(texts) - 1, -1, -1) if last else range(len(texts))) if worker.strip(texts[i]) == gone), None)
            if at is not None:
                del texts[at]
    ordered = sorted(((no is not None, no, worker.strip("\n".join(texts))) for no, texts in rows))
    return "\n\n".join(t for _, _, t in ordered if t)
