"""Containers: nothing lost, nothing split without need, proportions and fill."""

import random

import pytest
from pyspark.sql import functions as F

from verdigrade.llm import packing as pk

RNG = random.Random(2)


def test_long_text_in_stretches():
    text = "".join(RNG.choice(["word ", "  ", "\n\n", "x" * 300, " don't", "ß ", "日本", " "]) for _ in range(30_000))
    assert pk.n_tokens(text) == len(pk._encoder(pk.TOKENIZER).encode_ordinary(text))
    assert pk.n_tokens(None) == pk.n_tokens("") == 0


def test_fill():
    items = [(RNG.randrange(1, 101), RNG.choice("aab"), i) for i in range(3000)]
    got = pk.fill(items, 100, {"a": 2 / 3, "b": 1 / 3}, {})
    assert sorted(i for i, _ in got) == list(range(3000))
    used = {}
    for i, c in got:
        used[c] = used.get(c, 0) + items[i][0]
    least = max(-(-sum(used.values()) // 100), sum(n > 50 for n, _, _ in items))  # no packing needs fewer
    assert max(used.values()) <= 100 and len(used) <= 1.01 * least
    half, a = len(used) // 2, sum(items[i][0] for i, c in got if c < len(used) // 2 and items[i][1] == "a")
    assert abs(a / sum(v for c, v in used.items() if c < half) - 2 / 3) < 0.03


def test_debts_carry_over():
    items = [(10, s, (s, i)) for i in range(200) for s in "ab"]
    first = [s for (s, _), c in pk.fill(items, 100, {"a": 0.5, "b": 0.5}, {"a": 400.0, "b": -400.0}) if c < 4]
    assert first.count("a") > 3 * first.count("b")


def test_whole_table(spark):
    words = lambda n: " ".join(RNG.choice(["alpha", "beta", "gamma", "x1", "die"]) for _ in range(n))
    rows = [(i, words(RNG.randrange(1, 120)), "hot" if i % 3 else f"s{i % 5}", 1) for i in range(900)] + [(1000, words(3000), "hot", 1), (1001, None, None, 1), (1002, "", "s1", 1), (None, "a b", "s1", 1), (5, "twice", "s1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, piece int")
    for shard in (10**9, 5_000):
        got = pk.pack(df, 256, tokens_per_shard=shard).collect()
        per, docs = {}, {}
        for r in got:
            per[r.container_id] = per.get(r.container_id, 0) + r.tokens
            docs.setdefault((r.doc_id, r.source, r.n_pieces), []).append(r)
        assert max(per.values()) <= 256
        assert sum(per.values()) == sum(pk.n_tokens(x[1]) for x in rows)
        assert len({r.doc_id for r in got}) == len({x[0] for x in rows})
        long = sorted((r.piece, r.first_token, r.tokens) for r in got if r.doc_id == 1000)
        assert [p for p, _, _ in long] == list(range(len(long))) and all(t == 256 for _, _, t in long[:-1])
        assert all(len(v) == k[2] for k, v in docs.items() if k[0] not in (5, None))
        assert sum(per.values()) / 256 / len(per) > 0.95
    assert pk.pack(df.limit(0), 256).count() == 0
    with pytest.raises(ValueError):
        pk.pack(df, 0)


def test_capacity(spark):
    m = spark.createDataFrame([("a", "1", 512), ("a", "2", 256), ("b", "1", None)], "model string, resolved_version string, context_window int")
    assert pk.capacity_of(m, "a") == 256 and pk.capacity_of(m, "a", "1") == 512
    with pytest.raises(ValueError):
        pk.capacity_of(m, "b")
    assert pk.packing_report(spark.createDataFrame([(1, 5), (1, 5), (2, 10)], "container_id int, tokens int"), 10).select(F.round("fill", 3)).first()[0] == 1.0


def _many(spark, sizes):
    """Texts of about so many tokens by source, with a name of their own for each."""
    rows, n = [], 0
    for source, (count, low, high) in sizes.items():
        for _ in range(count):
            rows.append((n, " x" * RNG.randrange(low, high), source))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixture_is_kept_and_the_surplus_apart(spark):
    df = _many(spark, {"a": (900, 5, 40), "b": (300, 5, 40), "c": (200, 5, 40)})
    mixture = {"a": 0.5, "b": 0.5}
    for shard in (10**9, 6_000):
        got = pk.pack(df, 128, mixture=mixture, tokens_per_shard=shard)
        rows = got.collect()
        assert sorted(r.doc_id for r in rows) == list(range(1400))
        inside = {s: sum(r.tokens for r in rows if r.in_mixture and r.source == s) for s in "abc"}
        assert inside["c"] == 0 and abs(inside["a"] / (inside["a"] + inside["b"]) - 0.5) < 0.02
        assert sum(r.tokens for r in rows if r.source == "b" and not r.in_mixture) <= 0.02 * inside["b"] + 40
        assert not {r.container_id for r in rows if r.in_mixture} & {r.container_id for r in rows if not r.in_mixture}
        report = {r.source: r for r in pk.mixture_report(got, mixture).collect()}
        assert set(report) == {"a", "b"} and all(r.target == 0.5 and abs(r.share - 0.5) < 0.02 for r in report.values())
    assert all(not r.in_mixture for r in pk.pack(df, 128, mixture={"a": 0.5, "nobody": 0.5}).collect())


def test_cumulative_deviation_is_bounded(spark):
    df = _many(spark, {"hot": (2000, 5, 60), "b": (600, 5, 60), "c": (300, 5, 60), "long": (5, 700, 900)})
    for shard in (10**9, 20_000):
        packed = pk.pack(df, 256, tokens_per_shard=shard)
        report = pk.mixture_report(packed).collect()
        assert abs(sum(r.share for r in report) - 1) < 1e-9 and sum(r.tokens for r in report) == packed.agg({"tokens": "sum"}).first()[0]
        total = sum(r.tokens for r in report)
        assert all(max(r.most_over, r.most_under) <= 0.06 * total for r in report if r.source != "long")
        assert all(max(r.most_over, r.most_under) <= 8 * 256 for r in report if r.source in "bc")


def test_rows_without_id_spread_over_shards(spark):
    df = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'same text of a few words' as text", "'s' as source")
    got = pk.pack(df, 64, tokens_per_shard=2_000).collect()
    shards = {r.container_id >> 30 for r in got}
    assert len(got) == 3000 and len(shards) >= 6
