import gzip
import time

import pytest
from pyspark.sql import functions as F

from cairnkit.llm import warc_audit as A
from tests.conftest import rows


@pytest.fixture(scope="module")
def pages(spark):
    data = [(i * 3, f"http://x/{i}", f"<p>é {i}</p>" * (i % 5), "k") for i in range(300)]
    data += [(None, None, None, None), (None, None, None, None), (3, "http://x/1", "again", ""), (3, "http://x/1", "again", ""), (5, "u", "", ""), (7, "long", "h" * 400_000, "")]
    return spark.createDataFrame(data, "page_id long, url string, html string, archive string")


def brute(one, other):
    """Of each archive and id: what one side holds more of, in its order, and the pairs that differ."""
    held = [{}, {}]
    for side, leaves in zip(held, (one, other), strict=True):
        for r in sorted(leaves.collect(), key=lambda r: r.node):
            side.setdefault((r.archive, r.record_id), []).append(r.digest)
    found = []
    for k in held[0].keys() | held[1].keys():
        a, b = (x.get(k, []) for x in held)
        more = [[d for i, d in enumerate(x) if x[: i + 1].count(d) > y.count(d)] for x, y in ((a, b), (b, a))]
        n = min(map(len, more))
        found += [(k, "changed")] * n + [(k, "missing")] * (len(more[0]) - n) + [(k, "added")] * (len(more[1]) - n)
    return sorted(found)


@pytest.mark.parametrize("fanout", [2, 16])
def test_audit_finds_what_comparing_all_finds(pages, fanout):
    one, other = A.leaves(pages, 100), A.leaves(A.damaged(pages).where("page_id is null or page_id < 880"), 100)
    want = brute(one, other)
    got = A.audit(one, other, fanout)
    assert sorted(((r.archive, r.record_id), r.kind) for r in got.collect()) == want and len(want) > 8
    assert {k for _, k in want} == {"changed", "missing", "added"}
    back = {"missing": "added", "added": "missing", "changed": "changed"}
    assert sorted(((r.archive, r.record_id), back[r.kind]) for r in A.audit(other, one, fanout).collect()) == want


def test_a_lost_record_is_located_and_those_after_it_are_not_told(pages):
    one = A.leaves(pages, 5000)
    for gone, extra, kind in ((33, None, "missing"), (None, 33, "added")):
        other = pages.where(f"page_id is null or page_id <> {gone or -1}")
        if extra:
            other = other.unionByName(pages.where(f"page_id = {extra}").withColumn("url", F.lit("http://y")))
        assert rows(A.audit(one, A.leaves(other, 5000)), "record_id", "kind") == [("33", kind)]


def test_equal_and_empty_replicas_give_nothing(pages):
    one = A.leaves(pages)
    assert A.audit(one, A.leaves(pages.repartition(7))).count() == 0
    assert A.audit(one.limit(0), one.limit(0)).count() == 0
    assert A.audit(one, one.limit(0)).count() == pages.count()
    with pytest.raises(ValueError, match="fanout"):
        A.tree(one, 1)


def test_levels_halve_down_to_the_roots_and_hold_the_ranges(pages):
    one = A.leaves(pages, 100).withColumn("replica", F.lit("a"))
    levels = A.tree(one, 4)
    roots = {r.archive: r for r in levels[-1].collect()}
    assert all(r.node == 0 and r.begin == 0 for r in roots.values())
    sizes = {r.archive: r.n for r in one.groupBy("archive").agg(F.sum(F.col("end") - F.col("begin")).alias("n")).collect()}
    assert {a: r.end for a, r in roots.items()} == sizes
    counts = [x.count() for x in levels]
    assert counts == sorted(counts, reverse=True) and counts[-1] == len(sizes)


def test_only_mismatching_branches_are_compared(spark, pages, monkeypatch):
    seen = []
    plain = A._differing
    monkeypatch.setattr(A, "_differing", lambda nodes: seen.append(nodes.count()) or plain(nodes))
    one = A.leaves(pages, 5000)
    other = one.withColumn("digest", F.when(F.col("node") == 77, F.lit("x")).otherwise(F.col("digest")))
    assert rows(A.audit(one, other, 4), "record_no", "kind") == [(77, "changed")]
    assert len(seen) > 3 and all(n <= 8 for n in seen)


@pytest.mark.parametrize("packed", [True, False])
def test_files_round_trip_and_audit(spark, pages, tmp_path, packed):
    end = ".warc.gz" if packed else ".warc"
    A.write_warc(pages, f"file://{tmp_path}/a", 100, packed)
    A.write_warc(pages, f"file://{tmp_path}/b", 100, packed)
    back = A.read_warc(spark, f"{tmp_path}/a/*{end}")
    assert back.count() == pages.count() and back.where("fault is not null").count() == 0
    want = sorted((r.html or "").encode() for r in pages.collect())
    assert sorted(bytes(r.payload) for r in back.select("payload").collect()) == want
    leaves = A.stored_leaves(back)
    same = ["archive", "node", "record_id", "digest"] + ([] if packed else ["begin", "end"])
    assert rows(leaves, *same) == rows(A.leaves(pages, 100), *same)
    victim = tmp_path / "b" / f"archive-4{end}"
    raw = victim.read_bytes()
    hit = list(A.parse(raw))[9]
    old = raw[hit.offset : hit.offset + hit.length]
    new = gzip.compress(gzip.decompress(old).replace(b"<p>", b"<q>"), mtime=0) if packed else old.replace(b"<p>", b"<q>")
    victim.write_bytes(raw[: hit.offset] + new + raw[hit.offset + hit.length :])
    (tmp_path / "b" / f"archive-2{end}").unlink()
    got = A.audit(leaves, A.stored_leaves(A.read_warc(spark, f"{tmp_path}/b/*{end}"))).collect()
    assert [(r.archive, r.record_no, r.begin_a) for r in got if r.kind == "changed"] == [("archive-4", 9, hit.offset)]
    assert {r.archive for r in got if r.kind == "missing"} == {"archive-2"} and {r.kind for r in got} == {"changed", "missing"}


def test_headers_count_in_any_case_and_faults_are_records():
    raw = b"WARC/1.1\r\nContent-Length: 3\r\nWARC-Target-URI: u:v\r\n\r\nabc\r\n\r\n" * 2 + b"warc junk\nWARC/1.0\r\ncontent-length: 2\r\n\r\nxy\r\n\r\nWARC/1.0\r\nContent-Length: -1\r\n\r\nq\r\n\r\nWARC/1.0\r\n\r\nq\nWARC/1.0\r\nContent-Length: 9\r\n\r\nab"
    got = list(A.parse(raw))
    assert [(g.payload, g.fault) for g in got] == [(b"abc", None), (b"abc", None), (b"", "no WARC record"), (b"xy", None), (b"", "Content-Length is '-1'"), (b"", "no Content-Length"), (b"ab", "2 of 9 bytes of payload")]
    assert got[0].headers["warc-target-uri"] == "u:v" == got[1].headers.get("WARC-Target-URI")
    assert got[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(got, got[1:], strict=False)) and sum(g.length for g in got) == len(raw)
    assert [g.fault for g in A.parse(b"hello")] == ["no WARC record"] and list(A.parse(b"")) == []
    whole = [gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\n%d\r\n\r\n" % i, mtime=0) for i in range(4)]
    broken = whole[0] + whole[1][:12] + b"\xff\xff" + whole[1][14:] + whole[2] + whole[3][:-9]
    got = list(A.parse(broken))
    assert [g.payload for g in got if not g.fault] == [b"0", b"2"] and got[1].fault and got[-1].fault == "gzip member cut off"


def test_parsing_takes_time_in_proportion():
    def took(n):
        body = bytes(range(256)) * 30
        raw = b"".join(gzip.compress(b"WARC/1.1\r\nContent-Length: 7680\r\n\r\n" + body + b"\r\n\r\n", 0, mtime=0) for _ in range(n))
        began = time.process_time()
        assert sum(1 for _ in A.parse(raw)) == n
        return time.process_time() - began

    took(100)
    assert took(8000) < 8 * max(took(2000), 0.05)


def test_a_foreign_file_stops_no_other(spark, pages, tmp_path):
    A.write_warc(pages.limit(20), f"file://{tmp_path}/a", 100)
    (tmp_path / "a" / "x.warc.gz").write_bytes(b"not an archive")
    (tmp_path / "a" / "empty.warc.gz").write_bytes(b"")
    got = A.read_warc(spark, f"{tmp_path}/a/*.warc.gz")
    assert got.count() == 21 and [(r.archive.rsplit("/", 1)[-1], r.begin, r.end) for r in got.where("fault is not null").collect()] == [("x.warc.gz", 0, 14)]
    A.write_warc(pages.limit(0), f"file://{tmp_path}/none")
