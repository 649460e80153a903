import random

import numpy as np
import pytest

from cairnkit.llm import packing


def slow(sizes, lengths):
    """The rule, tried bin by bin."""
    bins = []
    for i, size in enumerate(sizes):
        fit = [(cap - sum(held) - size, k) for k, (cap, held) in enumerate(bins) if cap - sum(held) >= size]
        if fit:
            bins[min(fit)[1]][1].append(size)
            continue
        prices = []
        for cap in lengths:
            if cap >= size:
                hope = min(cap, size + sum(x for x in sizes[i + 1 :] if x <= cap - size))
                prices.append((packing.bin_cost(cap) / hope, cap))
        bins.append((min(prices, key=lambda p: p[0])[1], [size]))
    return [(min(c for c in lengths if c >= sum(held)), held) for _, held in bins]


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_slow_rule(seed):
    rng = random.Random(seed)
    lengths = (16, 32, 64)
    sizes = sorted((rng.choice([rng.randrange(1, 65), rng.randrange(1, 9), 64]) for _ in range(rng.randrange(1, 120))), reverse=True)
    bins, offsets, caps = packing.pack_sizes(np.array(sizes), lengths)
    got = [(int(c), [s for s, b in zip(sizes, bins, strict=True) if b == k]) for k, c in enumerate(caps)]
    assert got == slow(sizes, lengths)
    for k in range(len(caps)):
        mine = [(int(o), s) for o, s, b in zip(offsets, sizes, bins, strict=True) if b == k]
        assert [o for o, _ in mine] == np.cumsum([0, *[s for _, s in mine]])[:-1].tolist()


def test_several_lengths_cost_less_than_one():
    rng = np.random.default_rng(0)
    sizes = np.sort(np.minimum(8192, rng.lognormal(5.6, 1.2, 5000).astype(np.int64) + 1))[::-1]
    cost = {ls: sum(packing.bin_cost(int(c)) for c in packing.pack_sizes(sizes, ls)[2]) for ls in (packing.LENGTHS, (8192,))}
    caps = packing.pack_sizes(sizes)[2]
    assert cost[packing.LENGTHS] < 0.95 * cost[(8192,)] and sizes.sum() / caps.sum() > 0.97


def test_pack_covers_every_token_once(spark):
    rng = random.Random(2)
    data = [(i, "w " * rng.choice([1, 5, 30, 70, 300]), "z") for i in range(400)] + [(None, "a b", ""), (7000, "q r s", ""), (7000, "q r s", ""), (900, None, ""), (901, "", ""), (902, " \n ", ""), (903, "w " * 200_000, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, bin string")
    lengths = (16, 64)
    got = packing.pack(docs, lengths, shard_pieces=100).toPandas()
    assert got.bin.nunique() > 4 and {900, 901, 902}.isdisjoint(got.doc_id.dropna())
    size = got.to_token - got.from_token
    assert (size > 0).all() and (size <= 64).all()
    assert size.sum() == sum(len((t or "").split()) for _, t, _ in data)
    for doc, part in got[got.doc_id != 7000].groupby("doc_id"):
        part = part.sort_values("from_token")
        assert part.from_token.iloc[0] == 0 and (part.from_token.iloc[1:].values == part.to_token.iloc[:-1].values).all()
        assert part.piece.tolist() == list(range(len(part)))
        if doc == 903:
            assert len(part) == 3125
    assert (got.doc_id == 7000).sum() == 2 and got.doc_id.isna().sum() == 1
    held = size.groupby(got.bin).sum()
    assert (held == got.groupby("bin").bin_tokens.first()).all() and (held <= got.groupby("bin").bin_length.first()).all()
    assert set(got.bin_length) <= set(lengths)
    for _, part in got.groupby("bin"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == (part.to_token - part.from_token).cumsum().shift(fill_value=0).tolist()
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="positive"):
        packing.pack(docs, (0, 4))


def test_the_query_packs_tokens_of_the_tokenizer(spark, tmp_path):
    from cairnkit.llm import queries, token_counts

    docs = spark.createDataFrame([(1, "unspacedtext" * 5000), (2, "Some words, antidisestablishmentarianism and more."), (3, None), (4, "漢字" * 9000)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_packing(spark, str(tmp_path)).toPandas()
    want = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect() if r.n_tokens}
    assert (got.to_token - got.from_token).groupby(got.doc_id).sum().to_dict() == want
    assert want[1] > 8192 and (got.bin_tokens <= got.bin_length).all()


def test_pack_ids_holds_every_token_of_every_text(spark):
    from cairnkit.llm import tokens

    rng = random.Random(5)
    encode = tokens.encoding(tokens.Vocabulary.read()).encode_ordinary
    data = [(i, " ".join(rng.choice(["the", "qux", "漢", "9,"]) for _ in range(rng.choice([1, 4, 60, 300])))) for i in range(200)] + [(None, "no id"), (None, "no id too"), (7, "again"), (7, "again"), (300, None), (301, ""), (302, "  ")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = packing.pack_ids(docs, (16, 64), shard_pieces=50).toPandas()
    assert got.bin.nunique() > 5 and (got.to_token - got.from_token == got.token_ids.map(len)).all() and (got.token_ids.map(len) <= 64).all()
    whole = {}
    for r in got.sort_values("from_token").itertuples():
        if r.doc_id == r.doc_id and r.doc_id != 7:
            whole.setdefault(int(r.doc_id), []).extend(r.token_ids)
    assert whole == {i: encode(t) for i, t in data if i not in (None, 7) and t}
    assert sorted(got[got.doc_id.isna()].token_ids.map(list)) == sorted(map(encode, ("no id", "no id too")))
    assert sum(len(x) for x in got[got.doc_id == 7].token_ids) == sum(len(encode(t)) for i, t in data if i == 7)
    for _, part in got.groupby("bin"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == part.token_ids.map(len).cumsum().shift(fill_value=0).tolist() and part.token_ids.map(len).sum() == part.bin_tokens.iloc[0] <= part.bin_length.iloc[0]
    assert packing.pack_ids(docs.limit(0)).count() == 0


def test_rows_alike_are_spread_over_shards(spark):
    docs = spark.createDataFrame([(None, "a b c")] * 900 + [(5, "d e")] * 900 + [(i, "f") for i in range(100)], "doc_id long, text string")
    for got in (packing.pack(docs, (8,), shard_pieces=100), packing.pack_ids(docs, (8,), shard_pieces=100)):
        rows = got.toPandas()
        assert (rows.to_token - rows.from_token).groupby(rows.doc_id.isna()).size().sum() == 1900
        assert (rows.bin // 2**32).value_counts().max() < 250
