import random

import numpy as np
import pyarrow as pa
import pytest

from cairnkit.llm import _words, near_dedup, superminhash
from cairnkit.llm.components import _contract, components
from tests.conftest import rows


def words(text):
    (w,) = _words.blocks(pa.array([text]))
    raw = text.encode()
    return [raw[b:e].decode() for b, e in zip(w.begin, w.end, strict=True)]


def test_words_split_and_fold():
    assert words("Don't stop-it, Été 漢字x\n9") == ["Don", "t", "stop", "it", "Été", "漢", "字x", "9"]
    (w,) = _words.blocks(pa.array(["Ab été", None, "", "!!", "aB ÉTÉ"]))
    assert w.starts.tolist() == [0, 2, 2, 2, 2, 4]
    assert w.hashes[0] == w.hashes[2] and w.hashes[1] == w.hashes[3] and w.hashes[0] != w.hashes[1]


def test_blocks_are_the_same_whatever_their_size(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["é", "the", "Xy", "漢", "\n", "9,"]) for _ in range(rng.randrange(60))) for _ in range(50)]
    whole = [(w.hashes, w.begin) for w in _words.blocks(pa.array(texts))]
    monkeypatch.setattr(_words, "BLOCK_BYTES", 40)
    parts = [(w.hashes, w.begin) for w in _words.blocks(pa.array(["skip", *texts]).slice(1))]
    assert len(parts) > 5
    for k in range(2):
        assert np.array_equal(np.concatenate([p[k] for p in whole]), np.concatenate([p[k] for p in parts]))


def slow_signature(elements, slots):
    """The definition: for each element a Fisher-Yates shuffle, each slot the least j + r."""
    best = [None] * slots
    for e in elements:
        perm = list(range(slots))
        for j in range(slots):
            x = int(superminhash.mix(np.array([(int(e) + (j + 1) * int(superminhash.GOLDEN)) % 2**64], dtype=np.uint64))[0])
            k = j + ((x & 0xFFFF) * (slots - j) >> 16)
            perm[j], perm[k] = perm[k], perm[j]
            value = x >> 16 | j << 48
            if best[perm[j]] is None or value < best[perm[j]]:
                best[perm[j]] = value
    return [int(superminhash.mix(np.array([b], dtype=np.uint64))[0] >> np.uint64(32)) for b in best]


@pytest.mark.parametrize("n", [1, 3, 40, 300])
def test_signature_equals_the_definition(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 2**63, n, dtype=np.uint64)
    got = superminhash.signatures(np.concatenate([x, x[:1], x[::-1]]), np.array([0, 0, n + 1, 2 * n + 1]), 24)
    assert (got[0] == 2**32 - 1).all()
    assert got[1].tolist() == slow_signature(x, 24) == got[2].tolist()


def test_estimate_is_close_and_less_spread_than_minhash():
    rng = np.random.default_rng(5)
    off = []
    for _ in range(150):
        pool = rng.integers(0, 2**63, 90, dtype=np.uint64)
        s = superminhash.signatures(np.concatenate([pool[:60], pool[30:]]), np.array([0, 60, 120]), 160)
        off.append((s[0] == s[1]).mean() - 30 / 90)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < (1 / 3 * 2 / 3 / 160) ** 0.5


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    docs = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        docs.append(base)
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.02, 0.08, 0.3]) else w for w in base]
            docs.append(copy)
    rng.shuffle(docs)
    return [(i * 7, " ".join(d)) for i, d in enumerate(docs)]


def exact_pairs(data, threshold):
    sets = {}
    for i, t in data:
        w = t.split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    ids = sorted(sets)
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_recall_and_precision_against_all_pairs(spark):
    data = corpus(n=250)
    found = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    true = exact_pairs(data, 0.5)
    hit = sum(a in found and found.get(a) == found.get(b) for a, b in true)
    assert len(true) > 150 and hit >= 0.95 * len(true)
    loose = components(spark.createDataFrame([(a, b) for a, b in exact_pairs(data, 0.4)], "a long, b long"))
    roots = {r.node: r.root for r in loose.collect()}
    assert all(d in roots and roots[d] == roots[g] for d, g in found.items())


def test_edge_cases(spark):
    text = "one two three four five six seven"
    data = [(1, text, "x"), (2, text.upper() + "!", "y"), (3, None, None), (4, "", ""), (5, "?!", ""), (6, "", ""), (None, text, None), (7, "alone words here", "z"), (7, "alone words here", "z"), (8, "hi", ""), (9, "hi", ""), (10, "x " * 300_000, ""), (11, "x " * 300_000, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, group_id string")
    assert rows(near_dedup.near_duplicates(docs)) == [(1, 1), (2, 1), (8, 8), (9, 8), (10, 10), (11, 10)]
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert [r[0] for r in rows(kept, "doc_id")] == [1, 3, 4, 5, 6, 7, 8, 10, None]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0 and near_dedup.keep_one(docs.limit(0)).count() == 0


def test_contraction_equals_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert rows(components(df)) == rows(components(df, local_edges=0)) == sorted(set(rows(components(df))))
    assert _contract is not None and components(df.limit(0)).count() == 0
