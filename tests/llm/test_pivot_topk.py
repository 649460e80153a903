import numpy as np
import pytest

from cairnkit.llm import pivot_topk as P


def brute(ids, x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = {}
    for i, a in enumerate(ids):
        order = sorted((d[i, j], b) for j, b in enumerate(ids) if j != i)[:k]
        out[a] = [(b, pytest.approx(v, abs=1e-12)) for v, b in order]
    return out


def grouped(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.vec_id, []).append((r.neighbor_id, r.distance))
        assert len(out[r.vec_id]) == r.rank
    return out


def clusters(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dim))
    return centers[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * spread


@pytest.mark.parametrize(("spread", "dim"), [(0.05, 6), (2.0, 12), (0.0, 3)])
def test_equals_all_pairs(spark, spread, dim):
    x = clusters(700, dim, 3, spread)
    x[50:60] = x[10]
    ids = list(range(1000, 1700))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(5)
    assert grouped(P.top_k(df, k=7, every=1, pivots=5, block=64)) == brute(ids, x, 7)


def test_exact_far_from_the_origin(spark):
    x = clusters(300, 4, 9, 0.01) + 5e5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert grouped(P.top_k(df, k=3, every=1, pivots=5, block=40)) == brute(list(range(300)), x, 3)


@pytest.mark.parametrize("at_once", [1, 9, 10_000])
def test_a_query_set_in_turns_equals_all_pairs(spark, at_once):
    x = clusters(900, 8, 5, 0.3)
    x[100:110] = x[300]
    ids = list(range(-450, 450))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    want = {i: near for i, near in brute(ids, x, 4).items() if i % 50 == 0}
    assert grouped(P.top_k(df, k=4, pivots=6, block=70, at_once=at_once)) == want and len(want) == 18


def counted(x, queries, k, monkeypatch):
    """What search_block finds, how many distances it says to have evaluated, and how many it did, products included."""
    done = []
    offer, product = P.Nearest._offer, P.distances
    monkeypatch.setattr(P.Nearest, "_offer", lambda self, q, v, i, at: done.append(len(q)) or offer(self, q, v, i, at))
    points = P.choose_pivots(x[:200], 8)
    t = P.distances(x, points)
    monkeypatch.setattr(P, "distances", lambda a, b: done.append(len(a) * len(b)) or product(a, b))
    ids = np.arange(len(x))
    near = P.Nearest(x[queries], ids[queries], k)
    said = P.search_block(near, t[queries], x, ids, t)
    return {int(i): list(zip(f.tolist(), d.tolist(), strict=True)) for i, f, d in zip(near.ids, near.found, near.distance, strict=True)}, said, sum(done)


def test_bounds_come_before_distances(monkeypatch):
    x = clusters(1500, 5, 1, 0.01)
    found, said, done = counted(x, np.arange(1500), 5, monkeypatch)
    assert done < 0.2 * 1500 * 1500 and said - 1500 <= done
    assert found == brute(list(range(1500)), x, 5)


def test_a_product_is_taken_where_bounds_exclude_little(monkeypatch):
    x = np.random.default_rng(2).normal(size=(800, 40))
    found, said, done = counted(x, np.arange(0, 800, 50), 5, monkeypatch)
    assert found == {i: v for i, v in brute(list(range(800)), x, 5).items() if i % 50 == 0} and done < 1.5 * 16 * 800


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (2, [3.0, 4.0]), (2, [9.0, 9.0]), (3, None), (None, [0.0, 1.0]), (4, [nan, 0.0]), (5, [inf, 0.0]), (6, [0.0]), (7, []), (8, [0.0, None]), (9, [0.0, 0.0]), (10, [1e200, 1e200])]
    df = spark.createDataFrame([(i, v, "c", "d") for i, v in data], "vec_id long, embedding array<double>, rank string, distance string")
    assert grouped(P.top_k(df, every=1)) == {1: [(9, 0.0), (2, 5.0)], 2: [(1, 5.0), (9, 5.0)], 9: [(1, 0.0), (2, 5.0)]}
    assert P.top_k(df.limit(0)).count() == 0 and P.top_k(df.where("vec_id = 1"), every=1).count() == 0 and P.top_k(df).count() == 0
    with pytest.raises(ValueError, match="positive"):
        P.top_k(df, k=0)
