"""The workers' text functions against the JVM's, and the plans that findings asked for."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cairnkit.functions import worker
from cairnkit.operators import chunk, clean, dedup, encode

ODD = ["", " ", "a", "a\x1cb c", "　x y z\x85", "\x1cx \x1f", "a b", "\n\n", "x\n  \n\ny", "é é", "\U0001f600 \U0001f601b", "\U0001f600\U0001f601"]


def brute(texts, threshold, size):
    kept = []
    for t in dict.fromkeys(x for x in map(worker.strip, texts) if x):
        flat = worker.flat(t)
        s = {flat[i : i + size] for i in range(max(1, len(flat) - size + 1))}
        if not any(len(s & o) / len(s | o) >= threshold for _, o in kept):
            kept.append((t, s))
    return [t for t, _ in kept]


@pytest.mark.parametrize("letters", ["abc ", "".join(map(chr, range(0x4E00, 0x4E00 + 9000)))])
def test_f1_jaccard_folds_numbers_in_the_workers(spark, letters):
    rng = random.Random(1)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts = [b[: rng.randint(1, len(b))] + rng.choice(letters) for b in base for _ in range(3)] + [" ", "ab", "abc"]
    df = spark.createDataFrame([(texts,), (None,), ([None, "", " q "],)], "c array<string>")
    for threshold, size in ((0.3, 5), (0.8, 2), (0.0, 5)):
        made = df.select(dedup.greedy(F.col("c"), threshold, size).alias("c"))
        assert [r.c for r in made.collect()] == [brute(texts, threshold, size), None, ["q"]]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "array_intersect" not in plan


def test_f1_a_long_document_is_folded_within_seconds(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(1500)) for _ in range(300)]
    began = time.time()
    assert len(dedup._fold_jaccard(texts, 0.3, 5)) == 300
    assert time.time() - began < 10


def test_words_and_strip_are_those_of_the_jvm(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    from cairnkit.functions import text as T

    old = F.regexp_replace("t", r"(?U)^\s+|\s+\z", "")
    got = df.select("t", T.strip(F.col("t")).alias("s"), old.alias("o"), F.filter(T.words(old), lambda x: x != "").alias("w"), T.tokens(old).alias("k"), T.lines(F.col("t")).alias("l")).collect()
    for r in got:
        assert r.s == r.o == worker.strip(r.t)
        assert (r.w, r.k, r.l) == (worker.words(r.s), worker.tokens(r.s), worker.lines(r.t))


def test_f8_cleaning_sends_bounded_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(600).select(F.concat(F.lit("Ａ　"), F.repeat(F.lit("x y"), 20_000)).alias("t")).coalesce(1)
    made = df.select(clean.clean_code(clean.normalize_code(F.col("t"))).alias("t"))
    sizes = df.mapInArrow(lambda batches: (b.select([]).from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    assert made.where("t not like 'Ａ x y%' or t is null").isEmpty()
    assert max(r.n for r in sizes.collect()) < 8 << 20


@pytest.mark.parametrize("at_once", [1, 512])
def test_f2_f3_f4_keyword_best_equals_the_full_ranking_and_passes_on_few_rows(spark, monkeypatch, at_once):
    from cairnkit.operators import sparse

    monkeypatch.setattr(sparse, "QUERIES_AT_ONCE", at_once)
    rng = random.Random(3)
    docs = [(i % 2 and "ai" or "cyber", f"c{i:03d}", rng.choice([None, "", " ".join(rng.choice("a b cc dd é f_1 zz".split()) for _ in range(rng.randint(1, 9)))]), f"{i}.txt", "knowledge" if i % 3 else "baseline") for i in range(120)]
    chunks = spark.createDataFrame(docs, "zone_id string, chunk_id string, text string, filename string, record_type string").repartition(3)
    queries = spark.createDataFrame([(1, "ai", "a cc cc nothing"), (2, "cyber", "é zz"), (3, "ai", "!"), (4, "cyber", "nothing"), (5, "crypto", "a"), (6, "ai", "f_1 7 txt")], "query_id int, zone_id string, query string")
    allowed = chunks.where("record_type = 'knowledge'")

    def seen(df):
        return sorted(tuple(r) for r in df.select("query_id", "rank", "zone_id", "chunk_id", "score").collect())

    ok = F.col("record_type") == "knowledge"
    for k in (0, 1, 7, 200):
        assert seen(sparse.okapi_best(chunks, queries, k, ok)) == seen(sparse.rank(sparse.okapi_scores(chunks, queries, allowed), k))
        found = sparse.fulltext_best(chunks, queries, k, ok)
        assert seen(found) == seen(sparse.rank(sparse.fulltext_scores(chunks, queries, allowed), k))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_f10_pages_are_shuffled_once(spark):
    pages = spark.createDataFrame([(d, p, f"Head {d}\nbody {p}\n foot ") for d in (1, 2) for p in range(3)] + [(3, 0, None), (None, 0, "a\nb"), (None, 1, "a\nb")], "doc_id int, page_no int, page_text string")
    made = clean.clean_pages(pages, normalize=False)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    body = "body 0\n\nbody 1\n\nbody 2"
    assert {r.doc_id: r.text for r in made.collect()} == {1: body, 2: body, 3: "", None: "a\nb\n\na\nb"}


def test_f6_a_lone_chunk_needs_no_signature_and_blocks_change_none(spark, monkeypatch):
    text = "".join(random.Random(4).choice("abcdef ") for _ in range(900))
    whole = dedup.signature(text)
    monkeypatch.setattr(dedup, "BLOCK", 1 << 20)
    assert (dedup.signature(text) == whole).all()
    df = spark.createDataFrame([([" x "],), ([None, ""],), (None,), ([text, text.replace(" ", "  "), "other one"],)], "c array<string>")
    assert [r.c for r in dedup.minhash(df, "c").collect()] == [["x"], [], None, [text.strip(), "other one"]]


def test_f7_breaks_need_no_shuffle_and_no_whole_batch(spark):
    texts = [". ".join(f"s{d}{i} x" for i in range(n)) for d, n in enumerate((1, 0, 9, 2, 14, 3))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)

    def seen(kind):
        made = chunk.semantic_breaks(docs, lambda t: encode.fake(t, 32), kind, 60.0 if kind in ("percentile", "gradient") else 0.5)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        return [tuple(r) for r in made.collect()]

    for kind in chunk.BREAKPOINTS:
        want = seen(kind)
        assert len(want) == 1 + 9 + 2 + 14 + 3 and any(r[4] for r in want) and all((r[3] is None) == (r[1] == len(texts[r[0]].split(". ")) - 1) for r in want)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
        assert seen(kind) == want
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_f9_dropped_duplicates_runs_in_the_workers(spark):
    from cairnkit.options import Options
    from cairnkit.plans import ingest

    docs = spark.createDataFrame([("a/1.txt", "p q\n\np q\n\nr"), ("a/2.txt", ""), ("a/3.txt", None)], "source_path string, text string")
    made = ingest.stats(docs, Options(chunk_strategy="paragraph", chunk_max_tokens=60, chunk_overlap=10))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_replace" not in plan
    assert {tuple(r)[1:] for r in made.collect()} == {(3, 2, 1), (0, 0, 0), (None, None, 0)}
