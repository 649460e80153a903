import random
import re
import shutil
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnkit.llm import _words, queries
from cairnkit.llm import quality_rules as Q
from tests.conftest import rows

TEXTS = [None, "", " \n\t", "Plain words, in a sentence.\nAnd one more.", "A *** b%%% c### d$$$", "STOP!! THE!! NOISE!! NOW!!", "12 34 5678 901", "x " * 80, "same line\n" * 9, "what an idiot, such a moron " * 3, "a", "é" * 40 + " b", "Hi. " * 50_000, "漢字", "a b c d", "Idiot\n\n \n\nMORON\r\n\f\nx\nÉté été", "漢字仮名交じり文" * 40, "Œuvre ŒUVRE ÜBER über ×x"]
FLAGGED = ["idiot", "moron", "über"]


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in t)


def words(text):
    return re.findall(r"[\u3000-\ud7ff][A-Za-z0-9\x80-\u2fff\ue000-\U0010ffff]*|[A-Za-z0-9\x80-\u2fff\ue000-\U0010ffff]+", fold(text))


def hashes(some):
    return [int(h) for x in some for w in _words.blocks(pa.array([x])) for h in w.hashes.view(np.int64)]


def model(text, flagged=()):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if re.search("[^ \t\r\f]", x)]
    m = {
        "m_chars": len(t), "m_solid": sum(c not in Q.BLANKS for c in t), "m_lone": sum("\u3000" <= c <= "\ud7ff" for c in t), "m_words": len(w), "m_distinct_words": sum(len(set(w[k : k + 100])) for k in range(0, len(w), 100)), "m_lines": len(lines), "m_distinct_lines": len(set(lines)),
        "m_symbols": sum(c in Q.SYMBOLS for c in t), "m_capitals": sum("A" <= c <= "Z" for c in t), "m_digits": sum(c in "0123456789" for c in t), "m_bangs": sum(c in "!?" for c in t),
        "m_flagged": sum(x in flagged for x in w),
    }
    return m, sum(1 << r.bit for r in Q.RULES if eval(r.fails, {}, m))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 7 else None, t, "x", 5) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 5)], "doc_id long, text string, mask string, m_words long")


def test_ledger_equals_the_model(docs):
    got = Counter(tuple(r) for r in Q.ledger(docs, hashes(FLAGGED)).collect())
    want = Counter((i if i != 7 else None, model(t, FLAGGED)[1], *[model(t, FLAGGED)[0][m] for m in Q.MEASURES]) for i, t in [*enumerate(TEXTS), (3, TEXTS[3])])
    assert got == want
    assert Q.ledger(docs.limit(0)).count() == 0


def test_policies_and_ablation(docs):
    led = Q.ledger(docs)
    masks = [r.mask for r in led.collect()]
    for p in Q.POLICIES:
        assert [r[0] for r in Q.decide(led).select(f"rejected_{p.version}").collect()] == [bin(m & p.mask).count("1") > p.allowed for m in masks]
    loose = Q.Policy("loose", ("symbols", "capitals", "exclamations", "short_words"), allowed=1)
    got = {r.rule: (r.fails, r.rejected_alone, r.rejected_without) for r in Q.ablation(led, loose).collect()}
    for r in Q.RULES:
        if r.name in loose.rules:
            off = loose.mask & ~(1 << r.bit)
            over = [bin(m & loose.mask).count("1") > 1 for m in masks]
            left = [bin(m & off).count("1") > 1 for m in masks]
            assert got[r.name] == (sum(m >> r.bit & 1 for m in masks), sum(a and not b for a, b in zip(over, left, strict=True)), sum(left))
    assert all(tuple(r)[2:] == (0, 0, 0) for r in Q.ablation(led.limit(0)).collect())


def test_keep_returns_the_rows_that_pass(docs):
    kept = Q.keep(docs)
    assert kept.columns == docs.columns
    want = sorted(t for t in [*TEXTS, TEXTS[3]] if not bin(model(t)[1] & Q.CURRENT.mask).count("1") > 0)
    assert sorted(r.text for r in kept.collect()) == want and TEXTS[3] in want and TEXTS[4] not in want
    assert rows(Q.keep(docs.limit(0))) == []


def test_one_scan_without_shuffle(docs):
    plan = Q.keep(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.lists(st.sampled_from(["a", "É", "漢", "\n", "\r", " ", "x1", "!", "\n\n"]), max_size=300).map("".join)), max_size=5))
def test_measures_of_any_text(texts):
    got = Q.measure(pa.array(["" if t is None else t for t in texts], pa.string()), np.zeros(0, np.uint64))
    assert [{m: int(got[m][i]) for m in Q.MEASURES} for i in range(len(texts))] == [model(t)[0] for t in texts]


def test_clean_texts_of_any_length_script_and_spacing_pass(spark):
    rng = random.Random(1)
    common = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    long = " ".join(common[int(900 * rng.random() ** 3)] for _ in range(150_000))
    han = "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(400))
    spaced = "\n\n\n".join(" ".join(rng.choice(common) for _ in range(30)) for _ in range(6))
    docs = spark.createDataFrame([(1, long), (2, han), (3, spaced)], "doc_id long, text string")
    assert {r.doc_id for r in Q.keep(docs).collect()} == {1, 2, 3}


def test_words_are_flagged_by_labels_in_any_language(spark):
    rng = random.Random(2)
    common = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    bad = ["grumpf", "ärgling", "méchois"]
    data, marks = [], []
    for i in range(600):
        toxic = i % 8 == 0
        w = [rng.choice(common) for _ in range(80)] + ([rng.choice(bad) for _ in range(6)] if toxic else [])
        rng.shuffle(w)
        data.append((i, " ".join(w)))
        if i < 400:
            marks.append((i, int(toxic)))
    docs = spark.createDataFrame([*data, (None, "grumpf"), (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (5, None), (900, 1)], "doc_id long, toxic int")
    flagged = Q.flagged_words(docs, labels)
    assert set(hashes(bad)) <= set(flagged) and len(flagged) < 6
    held_out = {r.doc_id: r.mask >> 9 & 1 for r in Q.ledger(docs, flagged).where("doc_id between 400 and 599").collect()}
    assert all(held_out[i] == (i % 8 == 0) for i in range(400, 600))
    assert Q.flagged_words(docs, labels, labelled=10) == []  # too few of them are toxic
    assert Q.flagged_words(docs, labels.limit(0)) == Q.flagged_words(docs.limit(0), labels) == Q.flagged_words(docs, labels.where("toxic = 0")) == []


def test_op5_stores_its_ledger_and_the_ablations_over_it(spark, tmp_path):
    rng = random.Random(3)
    data = [(i if i != 7 else None, t) for i, t in enumerate(TEXTS)] + [(100 + i, f"{'vile ' * 6 if i % 9 == 0 else ''}" + " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))) for i in range(90)]
    spark.createDataFrame(data, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, int(i % 9 == 0)) for i in range(90)], "doc_id long, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = {n: queries.QUERIES[n](spark, str(tmp_path)) for n in ("op5_quality_rules", "quality_ablation")}
    for name, df in got.items():
        want = con.execute(queries.ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect())
    stored = [f.rsplit("/", 2) for f in got["op5_quality_rules"].inputFiles()]
    assert stored and {kind for _, kind, _ in stored} == {"ledger"}
    beside = spark.read.parquet(f"{stored[0][0]}/ablation")
    assert rows(beside) == rows(got["quality_ablation"])
    flagged = ["vile"]
    fails = [{r.name for r in Q.RULES if model(t, flagged)[1] >> r.bit & 1} for _, t in data]
    for r in beside.collect():
        p = next(p for p in Q.POLICIES if p.version == r.version)
        mine = [f & set(p.rules) for f in fails]
        assert (r.fails, r.rejected_alone, r.rejected_without) == (sum(r.rule in f for f in mine), sum(f == {r.rule} for f in mine), sum(bool(f - {r.rule}) for f in mine))
    assert beside.count() == sum(len(p.rules) for p in Q.POLICIES) and beside.where("rule = 'flagged_words' and version = 'v2' and rejected_alone = 10").count() == 1
    shutil.rmtree(f"{tmp_path}/documents.parquet")
    later = Q.Policy("later", ("few_words", "symbols"), allowed=1)  # a new policy needs no text
    assert Q.decide(Q.read(spark, f"{stored[0][0]}/ledger"), (later,)).where("rejected_later").count() == sum({"few_words", "symbols"} <= f for f in fails)
