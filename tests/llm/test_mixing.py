from collections import Counter

import pytest

from cairnkit.llm import mixing
from tests.conftest import rows

SCHEMA = "doc_id long, text string, source string, slot string"


def docs(spark, sizes, words=7):
    data = [(i, " ".join(["w"] * (1 + i % words)), s, "x") for s, n in sizes.items() for i in range(hash_base(s), hash_base(s) + n)]
    return spark.createDataFrame(data, SCHEMA)


def hash_base(s):
    return 10_000 * sum(map(ord, s))


def test_points_are_exact_and_even(spark):
    got = [r[0] for r in spark.range(2000).selectExpr(mixing.golden_point("id")).collect()]
    assert got == [i * 2654435769 % 2**32 for i in range(2000)]
    big = (1 << 40) + 12345
    assert spark.range(1).selectExpr(mixing.golden_point(f"{big}L")).first()[0] == big * 2654435769 % 2**32
    for n in (50, 500, 2000):
        cells = Counter(g * 10 >> 32 for g in got[:n])
        assert max(abs(cells[c] - n / 10) for c in range(10)) <= 3


def test_every_token_comes_in_each_epoch_and_blocks_are_equal(spark):
    d = docs(spark, {"a": 400, "b": 90, "c": 11})
    plan = mixing.plan(d, block_tokens=20, range_rows=50).toPandas()
    sizes = {r.doc_id: len(r.text.split()) for r in d.collect()}
    first = plan[plan.epoch == 0]
    by_doc = first.sort_values("from_token").groupby("doc_id")
    assert set(first.doc_id) == set(sizes)
    for doc, part in by_doc:
        assert part.from_token.iloc[0] == 0 and part.to_token.iloc[-1] == sizes[doc]
        assert (part.from_token.iloc[1:].values == part.to_token.iloc[:-1].values).all()
    held = (plan.to_token - plan.from_token).groupby([plan.source, plan.block, plan.epoch]).sum()
    last = plan.groupby("source").block.max()
    assert all(n == 20 for (s, b, e), n in held.items() if b != last[s])
    assert plan.slot.nunique() == plan.slot.max() + 1
    assert (plan.groupby("slot").source.nunique() == 1).all()
    inside = plan.sort_values(["slot", "piece"])
    for _, part in inside.groupby("slot"):
        assert part.piece.tolist() == [0, *(part.to_token - part.from_token).cumsum().tolist()[:-1]]


def test_prefixes_hold_the_weights(spark):
    d = docs(spark, {"a": 900, "b": 300, "c": 300})
    plan = mixing.plan(d, block_tokens=10, weights={"a": 0.5, "b": 0.3, "c": 0.2}, max_epochs=9).select("slot", "source").distinct().toPandas().sort_values("slot")
    for n in (20, 60, 150, len(plan)):
        share = plan.source[:n].value_counts()
        assert all(abs(share[s] - w * n) <= 3 for s, w in {"a": 0.5, "b": 0.3, "c": 0.2}.items())


def test_weights_hold_however_often_a_small_source_comes(spark):
    d = docs(spark, {"x": 20, "y": 980})
    plan = mixing.plan(d, block_tokens=50, weights={"x": 0.5, "y": 0.5}).select("slot", "source", "epoch").distinct().toPandas()
    share = plan.source.value_counts(normalize=True)
    assert abs(share["x"] - 0.5) < 0.02 and plan[plan.source == "x"].epoch.max() > 20 and plan[plan.source == "y"].epoch.max() <= 1
    capped = mixing.plan(d, block_tokens=50, weights={"x": 0.5, "y": 0.5}, max_epochs=4).select("slot", "source").distinct().toPandas()
    assert capped.source.value_counts(normalize=True)["x"] < 0.15
    with pytest.raises(ValueError, match="below 2"):
        mixing.plan(d, weights={"x": 1.0, "y": 1e-12})
    n = Counter(r.source for r in mixing.mix(d, block_tokens=50, weights={"x": 0.5, "y": 0.5}).collect())
    assert 0.8 < n["x"] / n["y"] < 1.25


def test_plan_does_not_depend_on_the_ranges(spark):
    d = docs(spark, {"a": 200, "b": 50})
    assert rows(mixing.plan(d, block_tokens=16, range_rows=7)) == rows(mixing.plan(d, block_tokens=16))


def test_edge_cases(spark):
    data = [(1, "a b c", None, "s"), (2, None, "x", "s"), (3, "", "x", None), (None, "d e", "x", "s"), (4, "f", "x", "s"), (4, "f", "x", "s"), (5, "w " * 100_000, "x", "s"), (6, " \n", None, "s")]
    d = spark.createDataFrame(data, SCHEMA)
    plan = mixing.plan(d, block_tokens=1000)
    assert {r[0] for r in plan.select("doc_id").distinct().collect()} == {1, None, 4, 5}
    first = plan.where("epoch = 0")
    assert first.where("doc_id = 4").count() == 2 and first.where("doc_id = 5").count() in (100, 101)
    mixed = mixing.mix(d, block_tokens=1000)
    assert mixed.columns == d.columns
    n = Counter(r.doc_id for r in mixed.collect())
    assert n[2] == n[3] == n[6] == 1 and n[4] >= 2 and n[5] >= 1 and n[1] >= 1
    assert mixing.plan(d.limit(0)).count() == 0 and mixing.mix(d.limit(0)).count() == 0
    assert {r.source for r in mixing.mix(d, weights={"x": 1.0}).collect()} == {"x"}


@pytest.mark.parametrize("alpha", [0.5, 1.0])
def test_mixed_documents_follow_the_weights(spark, alpha):
    d = docs(spark, {"a": 1600, "b": 100}, words=5)
    n = Counter(r.source for r in mixing.mix(d, block_tokens=15, alpha=alpha, max_epochs=9).collect())
    tokens = {"a": 1600, "b": 100}
    want = (tokens["b"] / tokens["a"]) ** alpha
    assert n["a"] >= 1600 and abs(n["b"] / n["a"] / want - 1) < 0.25
