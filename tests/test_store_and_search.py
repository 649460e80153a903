import json
import math
import random
import sqlite3
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnkit.operators import dense, hybrid, sparse
from cairnkit.options import Options
from cairnkit.plans.ingest import errors, records
from cairnkit.plans.service import build_service
from cairnkit.plans.store import ChunkStore
from cairnkit.schema import RECORD
from cairnkit.streaming.ingest import stream_into
from tests.conftest import rows

ZONE = "cyber"


def record(doc, text, vector, index=0, kind="knowledge", zone=ZONE):
    return (None, doc, zone, kind, text, [float(x) for x in vector], f"{doc}.md", f"/tmp/{doc}.md", ".md", index, 1, len(text), f"h-{doc}-{index}-{kind}", 1_700_000_000, len(text.encode()), "markdown", "zh")


def frame(spark, *data):
    return spark.createDataFrame(list(data), RECORD)


@pytest.fixture(params=["online", "offline"])
def service(request, spark, tmp_path):
    made = build_service(spark, str(tmp_path / "store"), request.param, dim=4)
    made.ensure_zone(ZONE, 4)
    return made


@pytest.fixture
def mixed(spark, service):
    service.upsert(ZONE, frame(spark, record("doc-knowledge", "network defense knowledge alpha", [0.8, 0.2, 0, 0]), record("doc-baseline", "network defense baseline controls", [1, 0, 0, 0], kind="baseline")))
    return service


def searches(service, filters):
    yield [r.doc_id for r in service.search(ZONE, [1, 0, 0, 0], 5, filters).collect()]
    yield [r.doc_id for r in service.sparse_search(ZONE, "network defense", 5, filters).collect()]
    yield [r.doc_id for r in service.hybrid_search(ZONE, "network defense", [1, 0, 0, 0], 5, filters).collect()]


def test_searches_follow_the_filter_contract(mixed):
    assert all(ids == ["doc-knowledge"] for ids in searches(mixed, None))
    assert all(ids == ["doc-baseline"] for ids in searches(mixed, {"record_type": "baseline"}))
    with pytest.warns(UserWarning, match="no_such"):
        assert all(ids == ["doc-knowledge"] for ids in searches(mixed, {"no_such": "x", "filename": None, "file_type": ["code"]}))
    assert [r.doc_id for r in mixed.get_baseline(ZONE).collect()] == ["doc-baseline"]
    hit = mixed.search(ZONE, [1, 0, 0, 0]).first()
    assert hit.metadata.filename == "doc-knowledge.md" and hit.rank == 1 and hit.score == pytest.approx(0.8 / math.hypot(0.8, 0.2), abs=1e-6)
    for empty in (mixed.search(ZONE, [1, 0, 0, 0], 0), mixed.hybrid_search(ZONE, "x", [1, 0, 0, 0], -1), mixed.sparse_search(ZONE, "!!!"), mixed.sparse_search(ZONE, " ")):
        assert empty.count() == 0


def test_deletes_count_live_rows_and_leave_others(spark, service):
    service.upsert(ZONE, frame(spark, record("gone", "to delete one", [1, 0, 0, 0]), record("gone", "to delete two", [0.9, 0.1, 0, 0], 1, "baseline"), record("keep", "keep me", [0, 1, 0, 0])))
    done = service.delete_by_doc_id(ZONE, "gone")
    assert (done.requested, done.deleted, len(done.chunk_ids)) == (2, 2, 2)
    assert [r.doc_id for r in service.store.chunks(ZONE).collect()] == ["keep"]
    assert service.delete(ZONE, done.chunk_ids).deleted == 0 and service.delete(ZONE, []).requested == 0 and service.delete_by_doc_id(ZONE, "").deleted == 0
    kept = service.store.chunks(ZONE).first().chunk_id
    assert service.delete(ZONE, [kept, "other"]) == type(done)(2, 1, [kept])


def test_upsert_replaces_keeps_birth_and_revives(spark, service):
    one = frame(spark, record("d", "old", [1, 0, 0, 0]), record("d", "new", [0, 2, 0, 0]))
    assert service.store.upsert(ZONE, one.coalesce(1), now=5) == service.store.upsert(ZONE, one.limit(0)).__class__(2, 2, 0)
    row = service.store.chunks(ZONE).first()
    assert (row.text, row.created_at, row.vector) == ("new", 5, [0.0, 1.0, 0.0, 0.0])
    service.delete_by_doc_id(ZONE, "d")
    assert service.store.upsert(ZONE, one.coalesce(1), now=9).updated == 1
    again = service.store.chunks(ZONE).collect()
    assert [(r.text, r.created_at, r.updated_at) for r in again] == [("new", 5, 9)]
    assert service.store.vacuum() == 2 and service.store.chunks(ZONE).count() == 1


def test_bad_records_change_nothing(spark, service):
    service.upsert(ZONE, frame(spark, record("d", "x", [1, 0, 0, 0])))
    for bad, why in ((record("e", "x", [1, 0, 0]), "another length"), (record("e", "x", [1, 0, 0, 0], zone="ai"), "not the target"), (record("e", "x", [1, 0, 0, 0], kind="other"), "record_type"), (record("e", "x", [1, 0, 0, 0], -1), "chunk_index")):
        with pytest.raises(ValueError, match=why):
            service.upsert(ZONE, frame(spark, record("ok", "x", [1, 0, 0, 0]), bad))
    assert service.store.chunks(ZONE).count() == 1
    for call in (lambda: service.search("mars", [1, 0, 0, 0]), lambda: service.search(ZONE, [1, 0]), lambda: service.ensure_zone(ZONE, 3), lambda: build_service(spark, "/tmp/x", "nearline"), lambda: ChunkStore(spark, "/tmp/x", distance="manhattan")):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("form", ["parquet", "jsonl"])
def test_export_counts_and_checksums(spark, service, tmp_path, form):
    import hashlib

    service.upsert(ZONE, frame(spark, record("k1", "one", [1, 0, 0, 0]), record("k2", "two", [0, 1, 0, 0]), record("b1", "base", [1, 0, 0, 0], kind="baseline")))
    manifest = service.export_zone(ZONE, str(tmp_path / "out"), form)
    assert (manifest["record_count"], manifest["baseline_count"], manifest["schema_version"]) == (2, 1, 1)
    folder = tmp_path / "out" / ZONE
    assert json.loads((folder / "manifest.json").read_text()) == manifest
    sums = json.loads((folder / "checksums.json").read_text())
    for name, digest in sums.items():
        assert hashlib.sha256((folder / name).read_bytes()).hexdigest() == digest
    back = spark.read.parquet(f"{folder}/chunks") if form == "parquet" else spark.read.json(f"{folder}/chunks")
    assert back.count() == 3


def test_zones_stand_apart(spark, service):
    for zone in (ZONE, "ai"):
        service.upsert(zone, frame(spark, record("d", "same", [1, 0, 0, 0], zone=zone)))
    service.delete_by_doc_id(ZONE, "d")
    assert service.store.chunks(ZONE).count() == 0 and service.store.chunks("ai").count() == 1 and service.store.counts("ai") == (1, 0)


def test_filters_prune_at_the_scan(mixed):
    plan = mixed.store.chunks(ZONE).where(dense.predicate(dense.normalize_filters({"doc_id": "d"})))._jdf.queryExecution().executedPlan().toString()
    assert "record_type#" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(doc_id,d)" in plan


def test_batch_search_is_the_same_by_broadcast_and_by_join(spark):
    rng = np.random.default_rng(0)
    data = [(f"c{i:03d}", "ai" if i % 3 else "cyber", [float(x) for x in rng.normal(size=5)]) for i in range(120)] + [("twin", "ai", None), ("odd", "ai", [1.0])]
    data.append(("c001b", "ai", data[1][2]))
    chunks = spark.createDataFrame(data, "chunk_id string, zone_id string, vector array<double>")
    queries = chunks.where("size(vector) = 5").selectExpr("chunk_id as query_id", "zone_id", "vector as query")
    for metric in dense.METRICS:
        one = rows(dense.batch_top_k(chunks, queries, 4, metric).select("query_id", "chunk_id", "rank"))
        assert one == rows(dense.batch_top_k(chunks, queries, 4, metric, broadcast_queries=0).select("query_id", "chunk_id", "rank")) and len(one) == 121 * 4
        q = data[1][2]
        best = [r.chunk_id for r in dense.top_k(chunks.where("zone_id = 'ai'").withColumn("record_type", F.lit("knowledge")), q, 4, metric=metric).orderBy("rank").collect()]
        assert best == [c for a, c, _ in one if a == "c001"] or sorted(best) == sorted(c for a, c, r in one if a == "c001")
        assert best[:2] == ["c001", "c001b"] or metric == "dot"


@pytest.mark.parametrize("at_once", [64, 4096])
def test_batches_take_null_ragged_and_int_keyed_queries(spark, at_once):
    chunks = spark.createDataFrame([(f"c{i}", "ai" if i % 2 else "cyber", [float(i), 1.0] if i != 5 else None) for i in range(40)] + [("r", "ai", [1.0])], "chunk_id string, zone_id string, vector array<double>")
    data = [(i, "ai", [1.0, i / 7]) for i in range(150)] + [(900, "ai", None), (901, "ai", [2.0]), (902, None, [1.0, 0.0]), (903, "ai", [])]
    for kind in ("int", "string"):
        queries = spark.createDataFrame([(i if kind == "int" else f"q{i:03d}", z, v) for i, z, v in data], f"query_id {kind}, zone_id string, query array<double>")
        got = dense.batch_top_k(chunks, queries, 3, "dot", broadcast_queries=at_once).collect()
        assert len(got) == 150 * 3 + 1 and {r.chunk_id for r in got if str(r.query_id).endswith("901")} == {"r"}
        assert all(r.chunk_id == "c39" for r in got if r.rank == 1 and not str(r.query_id).endswith("901"))
    assert dense.batch_top_k(chunks, queries, 0).count() == 0 and dense.batch_top_k(chunks, queries.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 7, 100])
def test_okapi_top_is_the_best_of_the_full_ranking(spark, k):
    rng = random.Random(k)
    docs = [" ".join(rng.choice(["a", "a", "bb", "ccc", "dd", "!!"]) for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    chunks = spark.createDataFrame([(f"c{i:02d}", "ai" if i % 3 else "crypto", t) for i, t in enumerate(docs)], "chunk_id string, zone_id string, text string")
    queries = spark.createDataFrame([(1, "ai", "a"), (2, "ai", "nothing"), (3, "crypto", "dd ccc a"), (4, "ai", "?!"), (5, "crypto", "bb")], "query_id int, zone_id string, query string")
    allowed = chunks.where("chunk_id not like '%7'")
    want = rows(sparse.rank(sparse.okapi_scores(chunks, queries, allowed), k), "query_id", "chunk_id", "score", "rank")
    assert rows(sparse.okapi_top(sparse.index(sparse.okapi_terms(chunks)), queries, k, allowed), "query_id", "chunk_id", "score", "rank") == want
    assert {r[0] for r in want} == {1, 2, 3, 5}


def test_the_index_is_kept_with_its_snapshot(spark, service, monkeypatch):
    service.upsert(ZONE, frame(spark, record("a", "alpha beta", [1, 0, 0, 0])))
    made, plain = [], sparse.index
    monkeypatch.setattr(sparse, "index", lambda terms: made.append(1) or plain(terms))
    for _ in range(3):
        assert [r.doc_id for r in service.sparse_search(ZONE, "beta").collect()] == ["a"]
    assert len(made) == 1
    service.upsert(ZONE, frame(spark, record("b", "beta beta", [0, 1, 0, 0])))
    assert {r.doc_id for r in service.sparse_search(ZONE, "beta").collect()} == {"a", "b"} and len(made) == 2
    service.store.vacuum()
    assert {r.doc_id for r in service.sparse_search(ZONE, "beta").collect()} == {"a", "b"} and len(made) == 2


def test_an_upsert_encodes_each_record_once(spark, service):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def vector(i):
        calls.add(1)
        return [float(i), 1.0, 0.0, 0.0]

    plain = frame(spark, *[record(f"d{i}", f"text {i}", [0, 0, 0, 0], i) for i in range(30)])
    service.upsert(ZONE, plain.withColumn("vector", vector("chunk_index")))
    assert calls.value == 30


def bm25_okapi(docs, query):
    tokens = [t.lower().split() for t in docs]
    n, avg = len(docs), sum(map(len, tokens)) / len(docs)
    df = Counter(w for t in tokens for w in set(t))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    return [sum(idf.get(q, 0) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for q in query.lower().split()) for t in tokens]


def test_okapi_equals_the_formula_and_keeps_zero_scores(spark):
    rng = random.Random(6)
    docs = [" ".join(rng.choice(["a", "b", "c", "dd", "ee", "ff", "zz_1"]) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    chunks = spark.createDataFrame([("ai", f"c{i:02d}", t) for i, t in enumerate(docs)], "zone_id string, chunk_id string, text string")
    queries = spark.createDataFrame([(1, "ai", "a dd dd nothing"), (2, "ai", "zz_1"), (3, "ai", "?!"), (4, "mars", "a")], "query_id int, zone_id string, query string")
    got = {(r.query_id, r.chunk_id): r.score for r in sparse.okapi_scores(chunks, queries).collect()}
    want = {(k, f"c{i:02d}"): s for k, q in ((1, "a dd dd nothing"), (2, "zz_1")) for i, s in enumerate(bm25_okapi(docs, q))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_fulltext_equals_sqlite(spark):
    rng = random.Random(7)
    docs = [(f"c{i:02d}", rng.choice(["ai", "cyber"]), " ".join(rng.choice(["alpha", "Bêta", "gamma", "delta", "x_y", "né"]) for _ in range(rng.randrange(1, 25))), f"f{i % 7}.md") for i in range(80)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(id unindexed, text, filename)")
    con.executemany("insert into t values (?, ?, ?)", [(i, t, f) for i, _, t, f in docs])
    chunks = spark.createDataFrame(docs, "chunk_id string, zone_id string, text string, filename string")
    for query in ("beta", "alpha gamma alpha", "NE", "f3 delta"):
        found = {r[0]: -r[1] for r in con.execute("select id, bm25(t) from t where t match ?", (" OR ".join(query.split()),))}
        asked = spark.createDataFrame([(z, z, query) for z in ("ai", "cyber")], "query_id string, zone_id string, query string")
        got = {r.chunk_id: r.score for r in sparse.fulltext_scores(chunks, asked).collect()}
        assert got.keys() == found.keys() and all(got[k] == pytest.approx(found[k], abs=1e-8) for k in found)


def test_fusion_equals_the_dictionary_rule(spark):
    rng = random.Random(1)
    for _ in range(3):
        a, b = rng.sample("abcdefghijklmnopqrstuvwxyz", 15), rng.sample("abcdefghijklmnopqrstuvwxyz", 15)
        score = {}
        for ranking in (a, b):
            for place, c in enumerate(ranking, 1):
                score[c] = score.get(c, 0) + 1 / (60 + place)
        want = sorted(score, key=lambda c: -score[c])[:12]
        frames = [spark.createDataFrame([(0, c, p) for p, c in enumerate(x, 1)], "query_id int, chunk_id string, rank int") for x in (a, b)]
        assert [r.chunk_id for r in hybrid.fuse(*frames, 12).orderBy("rank").collect()] == want


def test_records_end_to_end_and_by_stream(spark, tmp_path):
    import hashlib

    docs = spark.createDataFrame([("virtual/note.md", "# Title\n\nbody one\nbody one\n"), ("v/empty.txt", " \n"), ("v/mini.txt", "最小闭环验证文本"), ("v/null.txt", None)], "source_path string, text string")
    o = Options(embedding_mode="fake", embedding_dim=8, chunk_max_tokens=30, chunk_overlap=5)
    made = {r.filename: r for r in records(docs, "crypto", options=o).collect()}
    assert set(made) == {"note.md", "mini.txt"} and made["mini.txt"].text == "最小闭环验证文本" and made["note.md"].file_type == "markdown"
    r = made["note.md"]
    assert r.doc_id == hashlib.sha1(b"virtual/note.md").hexdigest() and r.chunk_id == hashlib.sha1(f"{r.doc_id}:0:{r.content_hash}".encode()).hexdigest() and len(r.vector) == 8
    assert rows(errors(docs, o)) == [("v/empty.txt", "empty after cleaning"), ("v/null.txt", "no text")]
    minhash = Options(embedding_mode="fake", embedding_dim=8, dedup_strategy="minhash", chunk_strategy="line")
    assert records(docs, "crypto", options=minhash).count() == 2
    store = ChunkStore(spark, str(tmp_path / "s"), dim=8)
    docs.where("text is not null").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("source_path string, text string").parquet(str(tmp_path / "in"))
        stream_into(stream, store, "crypto", str(tmp_path / f"ck{_}"), options=o).awaitTermination()
        assert store.counts("crypto") == (2, 0)


def test_options_from_the_environment():
    o = Options.from_env({"EMBEDDING_DIM": "-3", "CHUNK_MAX_TOKENS": "x", "CHUNK_OVERLAP": "-9", "DEDUP_MINHASH_THRESHOLD": "7", "DEDUP_MINHASH_PERM": "2", "SEMANTIC_BREAKPOINT_TYPE": "odd", "PRESERVE_INDENT": "yes"})
    assert (o.embedding_dim, o.chunk_max_tokens, o.chunk_overlap, o.dedup_minhash_threshold, o.dedup_minhash_perm, o.semantic_breakpoint_type, o.preserve_indent) == (384, 300, 0, 1.0, 16, "percentile", True)
