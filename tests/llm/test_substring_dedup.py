import random
import re

import numpy as np
import pytest

from cairnkit.llm import substring_dedup as S
from tests.conftest import rows


def vocabulary(rng, n=4000):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def prose(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    words = vocabulary(rng)
    hot = [prose(rng, words, rng.randrange(50, 75)) for _ in range(12)]
    data, inside = [], {}
    for i in range(150):
        lines = [prose(rng, words, rng.randrange(5, 140)) for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            p = rng.randrange(len(hot))
            k = rng.randrange(len(lines))
            w = lines[k].split(" ")
            at = rng.randrange(len(w) + 1)
            lines[k] = " ".join([*w[:at], hot[p], *w[at:]])
            inside.setdefault(p, []).append(i)
        data.append((i, "\n".join(lines)))
    return data, hot, inside


def test_every_planted_passage_is_cut_but_once_and_clean_texts_stay(spark, planted):
    data, hot, inside = planted
    docs = spark.createDataFrame(data, "doc_id long, text string")
    spans = S.repeats(docs).toPandas()
    texts = dict(data)
    for p, where in inside.items():
        for i in where[1:]:
            a = texts[i].index(hot[p])
            z = a + len(hot[p])
            mine = spans[(spans.doc_id == i) & (spans.start < z) & (spans.end > a)]
            covered = np.zeros(z - a, bool)
            for r in mine.itertuples():
                covered[max(0, r.start - a) : r.end - a] = True
            assert covered.mean() > 0.97, (p, i)  # all but the punctuation at its ends
    clean = {i for i, _ in data} - {i for where in inside.values() for i in where}
    assert clean.isdisjoint(spans.doc_id) and {w[0] for w in inside.values()}.isdisjoint(spans.doc_id)
    after = {r.doc_id: r.text for r in S.strip(docs).collect()}
    assert all(after[i] == texts[i] for i in clean)
    assert all(sum(hot[p] in t for t in after.values()) == 1 for p in inside)


def windows_by_hand(data):
    """Runs of 50 equal words that two documents share."""
    seen = {}
    for i, t in data:
        w = [x.lower() for x in re.findall(r"[A-Za-z0-9]+", t)]
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    return {d for where in seen.values() if len(where) > 1 for d in sorted(where)[1:]}


def test_every_shared_run_of_fifty_words_is_found(spark, planted):
    data, *_ = planted
    want = windows_by_hand(data)
    got = {r.doc_id for r in S.passages(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id").distinct().collect()}
    assert len(want) > 20 and want <= got


@pytest.mark.parametrize("min_words", [20, 33, 50])
def test_no_shared_run_of_min_words_is_missed(spark, min_words):
    rng = random.Random(min_words)
    words = vocabulary(rng)
    shared = [prose(rng, words, min_words) for _ in range(120)]
    data = [(i, prose(rng, words, rng.randrange(0, 40)) + " " + shared[i % 120] + " " + prose(rng, words, rng.randrange(0, 40))) for i in range(240)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    spans = S.passages(docs, min_words).toPandas()
    assert set(spans.doc_id) == set(range(120, 240)) and (spans.words >= min_words).all()
    short = [(i, prose(rng, words, 30) + " " + " ".join(shared[i % 120].split(" ")[: min_words // 2]) + " " + prose(rng, words, 30)) for i in range(240)]
    assert S.passages(spark.createDataFrame(short, "doc_id long, text string"), min_words).count() == 0


def test_least_of_sliding_runs():
    rng = np.random.default_rng(3)
    for n, wide in ((1, 1), (7, 3), (50, 50), (200, 43)):
        x = rng.integers(0, 99, n).astype(np.uint64)
        assert S._sliding_least(x, wide).tolist() == [x[i : i + wide].min() for i in range(n - wide + 1)]


def test_hard_wrapped_paragraphs_are_compared_as_wholes(spark):
    rng = random.Random(17)
    words = vocabulary(rng)

    def wrapped(w, at):
        return "\n".join(" ".join(w[k : k + at]) for k in range(0, len(w), at))

    one = [rng.choice(words) for _ in range(90)]
    two = [w if k % 25 else rng.choice(words) for k, w in enumerate(one)]  # no run of 29 is equal
    other = [rng.choice(words) for _ in range(60)]
    data = [(1, wrapped(one, 9) + "\n\n" + prose(rng, words, 70)), (2, prose(rng, words, 30) + "\n \n" + wrapped(two, 12)), (3, "Head\n" + " ".join(other) + "\n\n" + prose(rng, words, 40)), (4, prose(rng, words, 25) + "\n" + " ".join(other[:3] + ["x"] + other[4:])), (5, prose(rng, words, 24) + "\n" + prose(rng, words, 22)), (6, prose(rng, words, 300))]
    texts = dict(data)
    got = S.paragraphs(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_doc_id) for r in got} == {(2, 1), (4, 3)}  # a line isn't removed for its own paragraph
    hit = next(r for r in got if r.doc_id == 2)
    assert texts[2][hit.start : hit.end].split() == two
    twenty = prose(rng, words, 20)
    assert S.paragraphs(spark.createDataFrame([(1, twenty), (2, "a\n" + twenty), (3, "x\n" + prose(rng, words, 19))], "doc_id long, text string")).count() == 1


def test_paragraph_recall_and_exactness_against_all_pairs(spark):
    rng = random.Random(4)
    words = vocabulary(rng, 900)
    data = []
    for i in range(90):
        base = [rng.choice(words) for _ in range(rng.randrange(50, 120))]
        for c in range(rng.choice([1, 2, 4])):
            rate = rng.choice([0, 0.02, 0.05, 0.1, 0.2]) if c else 0
            data.append((len(data), "short line\n" + " ".join(rng.choice(words) if rng.random() < rate else w for w in base)))
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in data for w in [t.split("\n")[1].split()]}
    near = {i: [j for j in sets if j != i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= S.THRESHOLD] for i in sets}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, js in near.items():
        for j in js:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    want = {i for i in sets if find(i) != i}
    got = {r.doc_id for r in S.paragraphs(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert len(want) > 50 and len(got & want) >= 0.97 * len(want) and got <= want


def test_jaccard_is_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint32)) for _ in range(30)]
    for one in sets[:5]:
        assert S.jaccard(one, sets).tolist() == pytest.approx([len(np.intersect1d(one, x)) / len(np.union1d(one, x)) for x in sets])


def test_cut_spans():
    text = "Keep this.\nGone away now!\nand this, too"
    assert S.cut_spans(text, [(11, 24)]) == "Keep this.\nand this, too"
    assert S.cut_spans(text, [(0, 9)]) == "Gone away now!\nand this, too"
    assert S.cut_spans(text, [(26, 29), (30, 34)]) == "Keep this.\nGone away now!\n too"
    assert S.cut_spans(text, [(0, 400)]) == "" and S.cut_spans(text, []) == text


def test_edge_cases(spark):
    rng = random.Random(8)
    words = vocabulary(rng)
    p = prose(rng, words, 60)
    other = prose(rng, words, 70)
    data = [(1, p, "a", 1), (2, "é漢 " + other + " " + p.upper() + " end", "b", 2), (3, None, None, None), (4, "", "", 0), (None, p, "x", 5), (5, p + "\n" + p, "c", 9), (6, p, "d", 1), (6, p, "d", 1), (7, "w " * 300_000, "e", 1), (8, " ".join(words), "f", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, start string, n_chars long")
    spans = S.repeats(docs).toPandas()
    assert set(spans.doc_id) == {2, 5, 6} and (spans.keep_doc_id == 1).all()
    assert (spans[spans.doc_id == 2].start >= 3 + len(other)).all()
    after = S.strip(docs)
    assert after.columns == docs.columns
    got = sorted(rows(after, "doc_id", "text", "n_chars"), key=lambda r: (r[0] is None, r[0] or 0))
    # document 7 repeats one word: no run of it is less than its neighbours, and it stays
    assert [g[0] for g in got] == [1, 2, 3, 4, 7, 8, None]
    assert got[1][1].startswith("é漢") and got[1][1].endswith("end") and len(got[1][1]) < len(other) + 90 and got[1][2] == len(got[1][1])
    assert got[0][1] == p and got[0][2] == 1 and got[-1][1] == p
    assert S.repeats(docs.limit(0)).count() == 0 and S.strip(docs.limit(0)).count() == 0


def test_passages_are_cut_to_their_ends(spark, planted):
    data, hot, inside = planted
    rng = random.Random(5)
    words = vocabulary(rng)
    giant = prose(rng, words, 1500)  # without an anchor near its ends it takes further rounds
    flat = prose(rng, words, 40) + " same" * 900 + " " + prose(rng, words, 40)
    long = [(1000 + i, prose(rng, words, 20) + " " + x + " " + prose(rng, words, 20)) for i, x in enumerate((giant, giant, flat, flat))]
    texts = dict(data + long)
    spans = S.repeats(spark.createDataFrame(data + long, "doc_id long, text string")).toPandas()
    where = [(p, i) for p, at in inside.items() for i in at[1:]]
    for passage, i in [*((hot[p], i) for p, i in where), (giant, 1001), (flat, 1003)]:
        mine = spans[(spans.doc_id == i) & (spans.kind == "passage")]
        a = texts[i].index(passage)
        covered = np.zeros(len(texts[i]), bool)
        for r in mine.itertuples():
            covered[r.start : r.end] = True
            kept = texts[r.keep_doc_id][r.keep_start :]
            same = [re.findall(r"\w+", x)[: r.words] for x in (texts[i][r.start : r.end], kept)]
            assert same[0] == same[1] and len(same[0]) == r.words
        assert covered[a : a + len(passage.rstrip(",."))].all(), i
    assert {1000, 1002}.isdisjoint(spans.doc_id)
