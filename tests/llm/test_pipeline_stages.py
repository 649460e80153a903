import random
from collections import Counter

import pytest

import corpus_pipeline as C
from cairnkit.llm import quality_rules
from cairnkit.llm.tokens import Vocabulary, encoding
from tests.conftest import rows
from tests.llm.test_quality_rules import model


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(5000)]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))

    hot = prose(70)
    data, kinds = [], {}

    def add(text, kind):
        kinds[len(data)] = kind
        data.append((len(data), text, "en", rng.choice(["s1", "s1", "s1", "s2"]), None if text is None else len(text)))

    for _ in range(80):
        add(prose(rng.randrange(30, 200)), "clean")
    for i in range(0, 30, 3):
        w = data[i][1].split(" ")
        add(" ".join(rng.choice(words) if rng.random() < 0.03 else x for x in w), "near copy")
        add(data[i][1], "exact copy")
    for _ in range(6):
        add(prose(90) + "\n" + prose(30) + " " + hot + " " + prose(30), "passage")
    for bad in ("$$$ ### %%% &&&", "STOP!! NOW!! BUY!!", "", None, "x " * 90):
        add(bad, "bad")
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder), data, kinds, hot


def test_stages_one_by_one(spark, corpus):
    folder, data, kinds, hot = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in C.STAGES]
    assert names == ["quality_rules", "minhash_dedup", "substring_dedup", "source_mixing", "packing"]

    kept = C.quality(spark, docs, folder).cache()
    want = {i for i, t, *_ in data if not model(t)[1] & quality_rules.CURRENT.mask}
    assert {r.doc_id for r in kept.collect()} == want == {i for i, k in kinds.items() if k != "bad"}

    unique = C.near_duplicates(spark, kept, folder).cache()
    assert {r.doc_id for r in unique.collect()} == {i for i, k in kinds.items() if k in ("clean", "passage")}

    cut = C.repeated_passages(spark, unique, folder).cache()
    texts = {r.doc_id: r for r in cut.collect()}
    assert set(texts) == {i for i, k in kinds.items() if k in ("clean", "passage")}
    assert sum(hot in r.text for r in texts.values()) == 1
    assert all(texts[i].text == data[i][1] for i, k in kinds.items() if k == "clean")
    assert all(r.n_chars == len(r.text) for r in texts.values())

    mixed = C.source_mix(spark, cut, folder).cache()
    assert {r.doc_id for r in mixed.collect()} == set(texts)
    assert all(x.columns == columns for x in (kept, unique, cut, mixed))

    packed = C.packed_sequences(spark, mixed, folder).toPandas()
    tokens, encode = Counter(), encoding(Vocabulary.read()).encode_ordinary
    for r in mixed.collect():
        tokens[r.doc_id] += len(encode(r.text))
    assert (packed.to_token - packed.from_token).groupby(packed.doc_id).sum().to_dict() == dict(tokens)
    assert packed.token_ids.map(len).groupby(packed.doc_id).sum().to_dict() == dict(tokens)


def test_run_is_the_stages_in_order_and_repeatable(spark, corpus):
    folder, *_ = corpus
    one = C.run(spark, folder)
    assert rows(one) == rows(C.run(spark, folder)) and one.count() > 80


def test_stages_take_nulls_extra_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, group_id string, slot long, times int, gone int, id int, row int, spans int, turn int, __m_words int"
    data = [(1, "plain words in here", None, None, None, "g", 1, 2, *[None] * 6), (None, "no id at all", "en", "s", 1, None, None, None, *[5] * 6), (1, "plain words in here", None, None, None, "g", 1, 2, *[None] * 6), (2, *[None] * 13), (3, "w " * 200_000, "en", "s", 0, "", 0, 0, *[7] * 6)]
    docs = spark.createDataFrame(data, schema)
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
        out = stage(spark, docs, "")
        assert out.count() > 0
        if stage is not C.packed_sequences:
            assert out.columns == docs.columns
