import random

import duckdb
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnkit.llm import orc_tokens, queries, token_counts, tokens
from tests.conftest import rows

V = tokens.Vocabulary.read()
ENCODE = tokens.encoding(V).encode_ordinary


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["a", "b'll", "'", "s", " ", "  ", "\n", "\t", " ", "\x1c", "\x85", "é", "漢", "9", "!", "<|endoftext|>"]), max_size=14).map("".join)))
def test_chunks_give_the_ids_of_the_whole(text):
    first, *rest = tokens.chunks(text)
    assert [*ENCODE(first), *[i for c in rest for i in ENCODE(" " + c)]] == ENCODE(text)


def test_cache_stays_small_and_keeps_the_frequent():
    calls = []
    c = tokens.Cache(lambda t: calls.append(t) or len(t), {"the": 4}, most=3)
    for w in ["a", "b", "c", "d", "a", "the", "a"]:
        assert c[w] == len(w) + 1
    assert len(c) <= 4 and " the" not in calls and calls.count(" a") == 2


@pytest.fixture(scope="module")
def data():
    rng = random.Random(0)
    words = ["the", "of", "thntble", "Été,", "x1", "'s", "\n", "", "漢字", "don't", "$$$"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(120)]
    return [*enumerate([*texts, None, "", "  ", "a" * 50_000, "long text " * 60_000]), (None, "no id"), (3, texts[3])]


def test_token_counts_are_exact(spark, data):
    docs = spark.createDataFrame([(i, t, "c") for i, t in data], "doc_id long, text string, n_tokens string")
    want = sorted(((i, None if t is None else len(ENCODE(t))) for i, t in data), key=str)
    assert sorted(rows(token_counts.token_counts(docs)), key=str) == want
    assert sorted(rows(token_counts.token_counts(docs, table=1)), key=str) == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_frequent_chunks_come_from_the_vocabulary_without_a_shuffle(spark, data):
    found = token_counts.frequent(V)
    assert found[0] == "the"[: len(found[0])] and 10_000 < len(found) <= token_counts.TABLE and len(token_counts.frequent(V, 7)) == 7
    packed = token_counts.compact(["often", "é漢", ""], V)
    assert token_counts.expand(packed) == {c: len(ENCODE(" " + c)) for c in ["often", "é漢", ""]}
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("source", F.lit("s"))
    counted = token_counts.token_counts(docs, keep=["source"])
    assert counted.columns == ["doc_id", "n_tokens", "source"] and counted.where("source = 's'").count() == len(data)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_sql_gives_the_same_counts_and_ids(spark, data, tmp_path):
    con = duckdb.connect()
    odd = [(1000 + k, t) for k, t in enumerate(["a  b", "a \n  b", " \n", "x\u00a0\u2003y ", "don't we'll", "  lead", "tail  ", "1 23 ٣٤", "\x1c a"])]
    spark.createDataFrame([(i, t, "s") for i, t in [*data, *odd] if t is None or len(t) < 5000], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op3_token_counts", "op10_orc_tokens"):
        ran = con.execute(queries.ORACLES[name])
        names = [d[0] for d in ran.description]
        want = sorted(map(str, ran.fetchall()))
        assert want == sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, str(tmp_path)).select(*names).collect())


def test_ids_take_one_call_for_a_text():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefé漢", k=7)) for _ in range(rng.randrange(300))) for _ in range(40)] + [None, "", "  ", "<|endoftext|>"]
    calls = []
    make = tokens.id_bytes(V)
    sizes, lists = orc_tokens.id_lists(pa.array(["left out", *texts])[1:], lambda t: calls.append(t) or make(t))
    assert calls == [t for t in texts if t is not None]  # chunks looked up in a cache had a call for each rare word
    want = [None if t is None else ENCODE(t) for t in texts]
    assert orc_tokens.id_lists(pa.array(texts), tokens.cached_id_bytes(V))[1].to_pylist() == want
    assert lists.to_pylist() == want and sizes.to_pylist() == [None if w is None else len(w) for w in want]


def test_orc_round_trip_and_metadata(spark, data, tmp_path):
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(2)
    path = str(tmp_path / "ids")
    orc_tokens.write(docs, path, stripe_bytes=1 << 16, index_rows=1000)
    back = orc_tokens.read(spark, path)
    want = sorted([(i, None if t is None else len(ENCODE(t)), None if t is None else ENCODE(t)) for i, t in data], key=str)
    assert sorted([tuple(r) for r in back.collect()], key=str) == want
    assert [r.doc_id for r in orc_tokens.read(spark, path, [3, 999]).collect()] == [3, 3]
    plan = orc_tokens.read(spark, path, [3])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in plan
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in sorted((tmp_path / "ids").glob("part-*")):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000 and reader.getCompressionKind().toString() == "NONE"
        assert reader.getFileVersion().getName() == "0.12"
        stripe = reader.getStripes().get(0)
        footer = reader.rows().readStripeFooter(stripe)
        kinds = [(footer.getStreams(k).getKind().toString(), footer.getStreams(k).getColumn()) for k in range(footer.getStreamsCount())]
        assert ("BLOOM_FILTER_UTF8", 1) in kinds and ("ROW_INDEX", 1) in kinds
        assert footer.getColumns(4).getKind().toString() == "DIRECT_V2"
        reader.close()
    assert sum(orc.ORCFile(str(f)).nrows for f in (tmp_path / "ids").glob("part-*")) == len(data)


def test_orc_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    orc_tokens.write(spark.createDataFrame([], "doc_id long, text string"), path)
    assert orc_tokens.read(spark, path).count() == 0
