"""Column functions on text: stripping, tokens, hashes and file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnkit.functions.worker import SPACE

FILE_TYPES = {
    **dict.fromkeys((".txt", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".log"), "text"),
    **dict.fromkeys((".md", ".markdown"), "markdown"),
    **dict.fromkeys((".py", ".js", ".ts", ".java", ".go", ".c", ".cpp", ".h", ".hpp"), "code"),
    ".pdf": "pdf",
    ".docx": "docx",
}
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for a row, even where body uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space of any script at either end; only the ends are looked at."""
    return F.btrim(text, F.lit(SPACE))


def rstrip_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")


def lines(text: Column) -> Column:
    """The stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != "")


def words(text: Column) -> Column:
    """Words of a stripped, non-empty text."""
    return F.split(text, r"(?U)\s+")


def tokens(text: Column) -> Column:
    """Window tokens of a stripped text: its words if it has a space, else its characters."""
    return F.filter(F.when(F.instr(text, " ") > 0, words(text)).otherwise(F.split(text, "")), lambda x: x != "")


def joiner(text: Column) -> Column:
    return F.when(F.instr(text, " ") > 0, F.lit(" ")).otherwise(F.lit(""))


def search_terms(text: Column) -> Column:
    """Keyword tokens: lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def doc_key(source_path: Column) -> Column:
    return F.sha1(source_path)


def content_hash(text: Column) -> Column:
    return F.sha1(strip(text))


def chunk_key(doc_id: Column, chunk_index: Column, text_hash: Column) -> Column:
    return F.sha1(F.concat_ws(":", doc_id, chunk_index.cast("string"), text_hash))


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """The lower-case suffix with its dot; none for names such as `.profile` or `name.`."""
    return F.lower(F.regexp_extract(filename(path), r"[^.].*?(\.[^.]+)$", 1))


def file_type(ext: Column, default: str | None = "text") -> Column:
    """The business type of an extension; `default` (null: unsupported) for others."""
    table = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.lit(default))
