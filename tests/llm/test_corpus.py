"""Packing and mixing: exact accounts of their results."""

import random

from pyspark.sql import functions as F

from webloom.llm import mixing, packing
from webloom.llm.tokens import token_counts

BUDGETS = [(1, 512), (2, 2048), (3, 700)]


def packed(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id BIGINT, n_tokens BIGINT")
    budgets = spark.createDataFrame([*BUDGETS, (9, 0), (10, None)], "budget_id INT, capacity_tokens INT")
    return packing.pack(df, budgets).collect()


def check(rows, sizes):
    caps = dict(BUDGETS)
    for budget, cap in caps.items():
        own = [r for r in rows if r.budget_id == budget]
        load, seen = {}, {}
        for r in own:
            if r.container_id is not None:
                load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
            seen.setdefault(r.doc_id, []).append(r)
        assert max(load.values(), default=0) <= cap and set(load) == set(range(len(load)))
        for i, n in enumerate(sizes):
            parts = sorted(seen[i], key=lambda r: r.piece)
            assert sum(p.n_tokens for p in parts) == n
            assert len(parts) == max(1, -(-n // cap)) and [p.token_start for p in parts] == [k * cap for k in range(len(parts))]
            assert all((p.container_id is None) == (n == 0) for p in parts)
        yield sum(sizes) / (len(load) * cap) if load else 1.0


def test_packing(spark):
    random.seed(1)
    sizes = [int(random.lognormvariate(5.5, 0.8)) for _ in range(3000)] + [0, 1, 512, 513, 2048, 40_000]
    fills = list(check(packed(spark, sizes), sizes))
    assert min(fills) > 0.96
    hot = sizes + [300] * 1500
    list(check(packed(spark, hot), hot))


def test_packing_edges(spark):
    assert packed(spark, []) == []
    assert list(check(packed(spark, [0, 0]), [0, 0])) == [1.0, 1.0, 1.0]
    list(check(packed(spark, [511] * 40), [511] * 40))


def test_plan_fills_exactly():
    made = packing.plan({100: 50, 412: 50, 171: 30, 341: 30, 200: 10, 312: 10}, 512)
    assert sum(m for _, m in made) == 90
    assert all(sum(length * k for length, k in c) == 512 for c, _ in made)


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "ü" * 5000)], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 0


def test_budgets_go_to_siblings_first():
    rows = [("a", "x", "en", 100, 0.25, 1), ("b", "x", "en", 10_000, 0.25, 1), ("c", "y", "en", 10_000, 0.5, 1), ("d", "y", "de", 50, 0.0, 1)]
    got = mixing.budgets(rows, 1000)
    assert got == {"a": 100.0, "b": 400.0, "c": 500.0, "d": 0.0}
    assert mixing.budgets(rows, 10**9) == {"a": 100, "b": 10_000, "c": 10_000, "d": 0}


def test_mix(spark):
    sizes = [(i, "s1", "EN-us", 10 + i % 7) for i in range(900)] + [(1000 + i, "s2", None, 50) for i in range(20)] + [(2000 + i, None, "en", 5) for i in range(5)] + [(3000, "s3", "de", 9), (3001, "s1", "en", 0)]
    df = spark.createDataFrame(sizes, "doc_id BIGINT, source STRING, lang STRING, n_tokens BIGINT").withColumn("repeats", F.lit(7))
    targets = spark.createDataFrame([("s1", 0.7, 2), ("s2", 0.3, 3), ("s4", 0.0, None)], "source STRING, target_share DOUBLE, max_repeats INT")
    drawn, leaves = mixing.mix(df, targets, total=9000, buckets=8)
    rows = drawn.collect()
    most = {"s1": 2, "s2": 3}
    assert all(1 <= r.repeats <= most[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    got = {r.source: r for r in mixing.shares(drawn, leaves).collect()}
    assert set(got) == {"s1", "s2", "s4"} and got["s4"].tokens == 0
    assert abs(got["s1"].tokens - 6300) <= 8 and abs(got["s2"].tokens - 2700) <= 25
    again, _ = mixing.mix(df, targets, total=9000, buckets=8)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert mixing.mix(df.limit(0), targets)[0].count() == 0
