"""File sources: text, Markdown, code and DOCX by extension; PDF where its library is there."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnkit.exceptions import DocumentLoadError, UnsupportedFileTypeError
from cairnkit.functions.text import FILE_TYPES, extension, file_type, strip

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(raw: bytes) -> str:
    """By byte-order mark, else UTF-8, GB 18030 or Latin-1, the first that fits."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                break
    for name in ("utf-8", "gb18030"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def docx_text(raw: bytes) -> str:
    """The paragraphs with text of a DOCX body, one a line; tables and headers aren't read."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    found = []
    for p in body.findall(f"{_W}p") if body is not None else ():
        parts = [t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")]
        if "".join(parts).strip():
            found.append("".join(parts))
    return "\n".join(found)


def pdf_pages(raw: bytes, ocr: Callable[[object], str] | None = None, min_chars: int = 40, tables: bool = True) -> list[str]:
    """The pages' texts, tables as Markdown first, by PyMuPDF; pages of little text go to `ocr` if given."""
    try:
        import fitz
    except ImportError as e:
        raise DocumentLoadError("PyMuPDF is not installed") from e
    pages = []
    with fitz.open(stream=raw, filetype="pdf") as doc:
        for page in doc:
            body = page.get_text("text").strip()
            if ocr is not None and len(body) < min_chars:
                body = (ocr(page) or "").strip() or body
            blocks = [md_table(t.extract()) for t in page.find_tables().tables] if tables and hasattr(page, "find_tables") else []
            pages.append("\n\n".join(b for b in [*blocks, body] if b))
    return pages


def tesseract(lang: str = "chi_sim+eng", zoom: float = 2.5) -> Callable[[object], str]:
    """An `ocr` for pdf_pages() by pytesseract, which must be installed where it runs."""
    zoom = min(4.0, max(1.0, zoom))

    def read(page) -> str:
        import fitz
        import pytesseract
        from PIL import Image

        shot = page.get_pixmap(matrix=fitz.Matrix(zoom, zoom))
        return pytesseract.image_to_string(Image.frombytes("RGB", (shot.width, shot.height), shot.samples), lang=lang)

    return read


def md_cell(cell: str | None) -> str:
    return (cell or "").replace("\n", " ").replace("|", r"\|").strip()


def md_table(rows: list[list[str | None]]) -> str:
    """A Markdown table whose first row is the head; short rows are filled up."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    every = [[md_cell(c) for c in r] + [""] * (width - len(r)) for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [every[0], ["---"] * width, *every[1:]])


def markdown_table(rows: Column) -> Column:
    """md_table() of an array<array<string>> column, by JVM functions."""
    width = F.array_max(F.transform(rows, F.size))

    def line(cells: Column) -> Column:
        clean = F.transform(cells, lambda c: strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit(r"\|"))))
        return F.concat(F.lit("| "), F.array_join(F.concat(clean, F.array_repeat(F.lit(""), width - F.size(cells))), " | "), F.lit(" |"))

    head = line(F.element_at(rows, 1))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    rest = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.coalesce(width, F.lit(0)) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.array(head, rule), rest), "\n"))


def load(spark: SparkSession, paths: str | list[str], ocr: Callable[[object], str] | None = None) -> DataFrame:
    """(source_path, text, pages, file_type, size_bytes, mtime, error), a row for each file.

    paths are files, folders or globs of any file system that Spark knows. Files of unknown
    type, and those that can't be read, have their reason in error instead of a text; the
    others go on; empty files have no row. Texts are decoded in Arrow batches. A PDF has its pages as an array and
    their texts joined by blank lines in text. A file must fit in a worker's memory.
    """
    files = spark.read.format("binaryFile").load(paths)
    path = F.regexp_replace("path", "^file:/+", "/")
    known = files.select(path.alias("source_path"), file_type(extension(F.col("path")), None).alias("file_type"), F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("content"))
    schema = "source_path string, text string, pages array<string>, file_type string, size_bytes bigint, mtime bigint, error string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, pages, errors = [], [], []
            for name, kind, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                text, parts, error = None, None, None
                try:
                    if kind is None:
                        raise UnsupportedFileTypeError(f"unsupported file type: {PurePosixPath(name).suffix or name}")
                    if kind == "docx":
                        text = docx_text(raw)
                    elif kind == "pdf":
                        parts = pdf_pages(raw, ocr)
                        text = "\n\n".join(p for p in parts if p.strip())
                    else:
                        text = decode(raw)
                except Exception as e:  # noqa: BLE001: a file's fault is told in its row
                    error = f"{type(e).__name__}: {e}"
                texts.append(text)
                pages.append(parts)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(pages, pa.list_(pa.string())), batch.column(1), batch.column(2), batch.column(3), pa.array(errors, pa.string())], ["source_path", "text", "pages", "file_type", "size_bytes", "mtime", "error"])

    return known.mapInArrow(read, schema)


def load_one(spark: SparkSession, path: str, normalize: bool = False) -> str:
    """One document's text, cleaned by its type with normalize; raises what load() would tell in error."""
    from cairnkit.operators.clean import clean_text

    ext = PurePosixPath(path).suffix.lower()
    if ext not in FILE_TYPES:
        raise UnsupportedFileTypeError(f"unsupported file type: {ext or path}")
    try:
        rows = load(spark, path)
        text = clean_text(F.col("text"), F.col("file_type")) if normalize else F.col("text")
        found = rows.select(text.alias("text"), "error").collect()  # one file
    except Exception as e:
        raise DocumentLoadError(f"can't read {path}: {str(e).splitlines()[0]}") from e
    if len(found) != 1 or found[0].error:
        raise DocumentLoadError(found[0].error if found else f"no such file: {path}")
    return found[0].text


def scan(spark: SparkSession, folder: str, extensions: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(source_path, size_bytes, mtime) of a folder's own files with a known extension, by path."""
    wanted = [e.lower() for e in (extensions or FILE_TYPES)]
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("source_path"), F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("mtime"))
    found = files.where(extension(F.col("source_path")).isin(wanted)).orderBy("source_path")
    return found if limit is None else found.limit(limit)


def extension_histogram(files: DataFrame) -> DataFrame:
    """(extension, files) of a table with source_path."""
    return files.groupBy(extension(F.col("source_path")).alias("extension")).agg(F.count("*").alias("files"))
