"""WARC records, and a fixity audit of their replicas by Merkle trees."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnkit.llm._util import cut, small

FANOUT = 16
ARCHIVE_PAGES = 1024
DATE = "2024-01-01T00:00:00Z"
STEP_BYTES, HEAD_BYTES = 1 << 16, 1 << 20


def record(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """The WARC/1.1 resource record of a page as text; null parts count as empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Date: " + date + "\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def archive(page_id: Column, url: Column, pages: int = ARCHIVE_PAGES) -> Column:
    """The archive that holds a page: a range of page ids; pages without an id go by their url's md5."""
    return F.coalesce(F.concat(F.lit("archive-"), F.floor(page_id / pages).cast("string")), F.concat(F.lit("none-"), F.substring(F.md5(F.coalesce(url, F.lit(""))), 1, 4)))


def leaves(pages: DataFrame, archive_pages: int = ARCHIVE_PAGES) -> DataFrame:
    """(archive, node, record_id, digest, begin, end): the leaf of every page's record.

    node counts an archive's records in the order of page_id, url and digest, and begin and
    end are the record's byte offsets in the archive. record_id is the page_id as text, empty
    for null. digest is the SHA-256 of the record's bytes. Null ids, urls and htmls are
    allowed, repeated rows are records of their own, an empty table has no leaves. The
    records are hashed where they are read; what is shuffled are digests and lengths.
    """
    text = record(pages["page_id"], pages["url"], pages["html"])
    slim = pages.select(archive(pages["page_id"], pages["url"], archive_pages).alias("archive"), pages["page_id"].alias("page_id"), pages["url"].alias("url"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("length"))
    order = Window.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), "digest")
    end = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return slim.select("archive", (F.row_number().over(order) - 1).cast("long").alias("node"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("record_id"), "digest", (end - F.col("length")).alias("begin"), end.alias("end"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level: each run of fanout nodes hashed in order with the lengths of their ranges.

    Lengths, not offsets: a record of another size changes no node beside it.
    """
    group = nodes.groupBy("replica", "archive", F.floor(F.col("node") / fanout).alias("up"))
    children = F.array_sort(F.collect_list(F.struct("node", "digest", (F.col("end") - F.col("begin")).alias("size"))))
    digest = F.sha2(F.array_join(F.transform(children, lambda c: F.concat(c["node"].cast("string"), F.lit("+"), c["size"].cast("string"), F.lit(":"), c["digest"])), ";"), 256)
    return group.agg(digest.alias("digest"), F.min("begin").alias("begin"), F.max("end").alias("end")).withColumnRenamed("up", "node").select("replica", "archive", "node", F.lit(None).cast("string").alias("record_id"), "digest", "begin", "end")


def tree(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the trees of nodes (replica, archive, node, record_id, digest, begin, end), leaves first.

    The last level has one node, the root, for each archive of a replica.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    levels = [cut(nodes.select("replica", "archive", "node", "record_id", "digest", "begin", "end"))]
    most = levels[0].agg(F.max("node")).first()[0] or 0
    while most > 0:
        levels.append(cut(parents(levels[-1], fanout)))
        most //= fanout
    return levels


def _differing(nodes: DataFrame) -> DataFrame:
    """(archive, node) of the nodes that are unlike, or there in one replica only."""
    a, b = F.col("replica") == "a", F.col("replica") == "b"
    both = nodes.groupBy("archive", "node").agg(F.max(F.when(a, F.col("digest"))).alias("digest_a"), F.max(F.when(b, F.col("digest"))).alias("digest_b"))
    return both.where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).select("archive", "node")


def _within(nodes: DataFrame, found: DataFrame, place: Column) -> DataFrame:
    up = small(found.select(F.col("archive").alias("__a"), F.col("node").alias("__n")))
    return nodes.join(up, (nodes["archive"] == up["__a"]) & (place == up["__n"]), "left_semi")


def audit(one: DataFrame, other: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(archive, record_id, record_no, kind, begin_a, end_a, digest_a, begin_b, end_b, digest_b) of all records that differ.

    one and other are the leaves() of two replicas. Roots are compared first, and on each
    level below only the children of nodes that differ, so that what is compared grows with
    the damage and the depth, not with the archives. The records at places that differ are
    then paired by record_id: equal ones have only moved, because a record before them was
    lost or added, and aren't told. kind is `changed`, or `missing` or `added` as seen from
    the first replica, with nulls for the side that has no such record; record_no is its
    place in the first replica, or else in the other. Records that share an id are paired
    in their order. Equal replicas, and empty ones, give no rows. A record lost or added makes
    the rest of its archive differ by place, so that far is descended.
    """
    levels = tree(one.withColumn("replica", F.lit("a")).unionByName(other.withColumn("replica", F.lit("b"))), fanout)
    found = cut(_differing(levels[-1]))
    for nodes in reversed(levels[:-1]):
        found = cut(_differing(_within(nodes, found, F.floor(nodes["node"] / fanout))))
    # equal records first, then those of one id by their order
    apart = _within(levels[0], found, levels[0]["node"])
    alike = apart.withColumn("nth", F.row_number().over(Window.partitionBy("replica", "archive", "record_id", "digest").orderBy("node")))
    single = Window.partitionBy("archive", "record_id", "digest", "nth")
    left = alike.withColumn("sides", F.count("*").over(single)).where("sides = 1")
    paired = left.withColumn("nth", F.row_number().over(Window.partitionBy("replica", "archive", "record_id").orderBy("node")))
    sides = [F.max(F.when(F.col("replica") == name, F.col(c))).alias(f"{c}_{name}") for name in "ab" for c in ("node", "digest", "begin", "end")]
    both = paired.groupBy("archive", "record_id", "nth").agg(*sides)
    kind = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "added").otherwise("changed")
    return both.select("archive", "record_id", F.coalesce("node_a", "node_b").alias("record_no"), kind.alias("kind"), "begin_a", "end_a", "digest_a", "begin_b", "end_b", "digest_b")


def damaged(pages: DataFrame) -> DataFrame:
    """pages as a replica that has suffered, for rehearsing an audit.

    By the first two hex digits of the md5 of the id, one page in 256 each has its first
    character changed, is cut short by 7 characters, has lost its html, is lost, or has a
    second copy under another url.
    """
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    html = F.when(mark == "00", F.concat(F.lit("~"), F.expr("substring(html, 2)"))).when(mark == "01", F.expr("substring(html, 1, greatest(length(html) - 7, 0))")).when(mark == "02", F.lit("")).otherwise(F.col("html"))
    urls = F.when(mark == "04", F.array("url", F.concat("url", F.lit("#2")))).otherwise(F.array("url"))
    return pages.where(mark != "03").select("page_id", F.explode(urls).alias("url"), html.alias("html"))


def audit_sql(archive_pages: int = ARCHIVE_PAGES) -> str:
    """The audit of pages against damaged(pages) for DuckDB, comparing record by record."""
    mark = "substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 2)"
    html = f"CASE {mark} WHEN '00' THEN '~' || substr(html, 2) WHEN '01' THEN substr(html, 1, greatest(length(html) - 7, 0)) WHEN '02' THEN '' ELSE html END"
    crlf = "chr(13) || chr(10)"

    def side(name: str, url: str, body: str, where: str) -> str:
        return f"""{name}0 AS (SELECT page_id, {url} AS url, coalesce({body}, '') AS body FROM pages WHERE {where}),
        {name}1 AS (SELECT *, coalesce('archive-' || CAST(CAST(floor(page_id / {archive_pages}) AS BIGINT) AS VARCHAR), 'none-' || substr(md5(coalesce(url, '')), 1, 4)) AS archive, 'WARC/1.1' || {crlf} || 'WARC-Type: resource' || {crlf} || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || {crlf} || 'WARC-Date: {DATE}' || {crlf} || 'WARC-Target-URI: ' || coalesce(url, '') || {crlf} || 'Content-Type: text/html' || {crlf} || 'Content-Length: ' || strlen(body) || {crlf} || {crlf} || body || {crlf} || {crlf} AS rec FROM {name}0),
        {name}2 AS (SELECT archive, page_id, url, sha256(rec) AS digest, strlen(rec) AS len FROM {name}1),
        {name}3 AS (SELECT archive, coalesce(CAST(page_id AS VARCHAR), '') AS record_id, row_number() OVER w - 1 AS node, digest, CAST(sum(len) OVER w AS BIGINT) - len AS begin_, CAST(sum(len) OVER w AS BIGINT) AS end_ FROM {name}2
          WINDOW w AS (PARTITION BY archive ORDER BY page_id NULLS FIRST, url NULLS FIRST, digest ROWS UNBOUNDED PRECEDING)),
        {name}4 AS (SELECT *, row_number() OVER (PARTITION BY archive, record_id, digest ORDER BY node) AS nth FROM {name}3)"""

    def left(name: str, beside: str) -> str:
        return f"{name} AS (SELECT * EXCLUDE nth, row_number() OVER (PARTITION BY archive, record_id ORDER BY node) AS nth FROM {name}4 ANTI JOIN {beside}4 USING (archive, record_id, digest, nth))"

    return f"""WITH {side("a", "url", "html", "true")}, {side("b", f"unnest(CASE WHEN {mark} = '04' THEN [url, url || '#2'] ELSE [url] END)", html, f"{mark} <> '03'")}, {left("a", "b")}, {left("b", "a")}
    SELECT archive, record_id, coalesce(a.node, b.node) AS record_no,
      CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'added' ELSE 'changed' END AS kind,
      a.begin_ AS begin_a, a.end_ AS end_a, a.digest AS digest_a, b.begin_ AS begin_b, b.end_ AS end_b, b.digest AS digest_b
    FROM a FULL JOIN b USING (archive, record_id, nth)"""


class Headers(dict):
    """Header fields, whose names are the same in capitals and small letters."""

    def __init__(self, lines: Iterable[str]):
        super().__init__((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in lines))

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)


@dataclass(frozen=True)
class Stored:
    """A record of a WARC file: its place in the stored bytes, what it holds, and what is wrong with it."""

    offset: int
    length: int
    headers: Headers
    payload: bytes
    digest: str
    fault: str | None = None


def _member(raw: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at that byte, its stored length, and its fault."""
    member, parts, upto = zlib.decompressobj(wbits=31), [], at
    try:
        while upto < len(raw) and not member.eof:
            parts.append(member.decompress(raw[upto : upto + STEP_BYTES]))
            upto = min(len(raw), upto + STEP_BYTES)
    except zlib.error as e:
        return b"".join(parts), upto - at, f"broken gzip member: {e}"
    return b"".join(parts), upto - len(member.unused_data) - at, None if member.eof else "gzip member cut off"


def _read(data: bytes | memoryview, exact: bool) -> tuple[Headers, bytes, int, str | None]:
    """(headers, payload, length, fault) of the record that data begins with; exact if data holds nothing else."""
    head_end = next((e for n in (HEAD_BYTES >> 8, HEAD_BYTES) if (e := bytes(data[:n]).find(b"\r\n\r\n")) >= 0), -1)
    if bytes(data[:5]) != b"WARC/" or head_end < 0:
        return Headers(()), b"", len(data), "no WARC record" if bytes(data[:5]) != b"WARC/" else "headers without an end"
    headers = Headers(bytes(data[:head_end]).decode(errors="replace").split("\r\n")[1:])
    begin, told = head_end + 4, headers.get("Content-Length", "")
    if not told.isascii() or not told.isdigit():
        return headers, b"", len(data), f"Content-Length is {told!r}" if told else "no Content-Length"
    payload = bytes(data[begin : begin + int(told)])
    fault = None if len(payload) == int(told) else f"{len(payload)} of {told} bytes of payload"
    return headers, payload, len(data) if exact else min(begin + int(told) + 4, len(data)), fault


def parse(raw: bytes) -> Iterator[Stored]:
    """The records of a WARC file, plain or a gzip member each, in one pass.

    Offsets and lengths are those of the stored bytes, digest is the SHA-256 of the record as
    it is when unpacked. Field names count in any case. What can't be read is told as a
    record with a fault, which reaches to the next gzip member or `WARC/` line that may begin
    a record; a record cut off comes with what is left of it. An empty file has no records.
    """
    view, at = memoryview(raw), 0
    while at < len(raw):
        packed = raw[at : at + 2] == b"\x1f\x8b"
        if packed:
            data, used, fault = _member(view, at)
            headers, payload, _, inner = _read(data, True)
            fault = fault or inner
            if fault and fault.startswith("broken"):
                used = _next(raw, at) - at
        else:
            headers, payload, used, fault = _read(view[at:], False)
            if fault and not fault.endswith("of payload"):
                used = _next(raw, at) - at
            data = view[at : at + used]
        yield Stored(at, used, headers, payload, hashlib.sha256(data).hexdigest(), fault)
        at += used


def _next(raw: bytes, at: int) -> int:
    """Where the next record may begin after byte at."""
    found = [x for x in (raw.find(b"\x1f\x8b\x08", at + 1), raw.find(b"\nWARC/", at + 1) + 1) if x > 0]
    return min(found, default=len(raw))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(archive, record_no, begin, end, record_id, uri, payload, digest, fault) of the WARC files at path.

    One task a file; each file must fit in a worker's memory, its records are passed on a few
    at a time. payload is binary, digest is that of the whole stored record. fault is null, or
    says why the bytes from begin to end aren't a record; other records and files go on.
    Records without a field have a null there, empty files no rows.
    """
    names = ["archive", "record_no", "begin", "end", "record_id", "uri", "payload", "digest", "fault"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for no, r in enumerate(parse(content.as_py())):
                    held.append((name, no, r.offset, r.offset + r.length, r.headers.get("WARC-Record-ID"), r.headers.get("WARC-Target-URI"), r.payload, r.digest, r.fault))
                    size += len(r.payload)
                    if len(held) >= 1000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, record_no long, begin long, end long, record_id string, uri string, payload binary, digest string, fault string")


def stored_leaves(records: DataFrame) -> DataFrame:
    """The leaves of read_warc()'s records, for auditing replicas of the files themselves.

    archive is the file's name without `.warc` or `.warc.gz`, record_id the page's where it
    is a page's record; bytes with a fault are leaves like any record.
    """
    name = F.regexp_replace(F.element_at(F.split("archive", "/"), -1), r"\.warc(\.gz)?$", "")
    page = F.regexp_replace(F.coalesce("record_id", F.lit("")), "^<urn:page:(.*)>$", "$1")
    return records.select(name.alias("archive"), F.col("record_no").alias("node"), page.alias("record_id"), "digest", "begin", "end")


def write_warc(pages: DataFrame, path: str, archive_pages: int = ARCHIVE_PAGES, packed: bool = True) -> None:
    """Write each archive's records to path/<archive>.warc.gz, a gzip member each, or unpacked to .warc.

    path is a URI that pyarrow's filesystems know, or a folder that all executors share.
    A file is written under another name and renamed when it is whole, so that a task that
    is run again leaves no half of it. Null parts count as empty, repeated rows are records
    of their own; an empty table writes no file.
    """
    named = pages.select(archive(pages["page_id"], pages["url"], archive_pages).alias("archive"), pages["page_id"].alias("page_id"), pages["url"].alias("url"), record(pages["page_id"], pages["url"], pages["html"]).alias("record"))
    ordered = named.repartition("archive").sortWithinPartitions("archive", F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), F.sha2(F.col("record").cast("binary"), 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, folder = fs.FileSystem.from_uri(path)
        where.create_dir(folder)
        current, out, temp, done = None, None, "", []

        def close() -> None:
            if out:
                out.close()
                where.move(temp, f"{folder}/{current}.warc" + ".gz" * packed)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if name != current:
                    close()
                    temp = f"{folder}/_{name}.{uuid.uuid4().hex}"
                    current, out = name, where.open_output_stream(temp, compression=None)
                    done.append(name)
                out.write(gzip.compress(text.encode(), mtime=0) if packed else text.encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["archive"])

    ordered.mapInArrow(run, "archive string").write.format("noop").mode("overwrite").save()
