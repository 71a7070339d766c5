"""Exact sizes, gapless slots, uniform draws and edge cases of the sharding operator."""

import math
from collections import Counter

import numpy as np
import pytest

from marketlens.llm import sharding


def test_matrix_sums():
    blocks, cells = [5, 0, 40, 11], [14, 14, 14, 14]
    matrix = sharding.communication_matrix(blocks, cells)
    assert [sum(r) for r in matrix] == blocks
    assert [sum(c) for c in zip(*matrix)] == cells
    with pytest.raises(ValueError):
        sharding.communication_matrix([1], [2])


def test_draws_follow_the_law():
    rng = np.random.default_rng(1)
    good, bad, draws, n = 6, 9, 5, 20_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
    for k in range(draws + 1):
        p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
        assert abs(seen[k] / n - p) < 0.015
    large = [sharding.hypergeometric(rng, 10**11, 3 * 10**11, 10**6) for _ in range(50)]
    assert abs(np.mean(large) - 250_000) < 500


def shuffled(spark, n, **more):
    df = spark.range(n).selectExpr("id AS doc_id", "cast(null AS string) AS note")
    return sharding.shuffle_to_shards(df, shards=5, blocks=12, **more).collect()


def test_sizes_and_slots(spark):
    rows = shuffled(spark, 1003)
    sizes = Counter(r["shard"] for r in rows)
    assert [sizes[s] for s in range(5)] == [201, 201, 201, 200, 200]
    assert sorted(r["doc_id"] for r in rows) == list(range(1003))
    for s in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert {tuple(r) for r in rows} == {tuple(r) for r in shuffled(spark, 1003)}
    assert {tuple(r) for r in rows} != {tuple(r) for r in shuffled(spark, 1003, seed=7)}


def test_position_is_uniform(spark):
    seen = Counter()
    for seed in range(12):
        for r in shuffled(spark, 500, seed=seed):
            seen[r["doc_id"] // 100, r["shard"]] += 1
    # 25 cells of 240 expected rows each.
    assert sum((v - 240) ** 2 / 240 for v in seen.values()) < 60


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shuffle_to_shards(empty).collect() == []
    one = spark.createDataFrame([(None, None)] * 7 + [(1, "x")] * 9,
                                "doc_id long, shard string")
    rows = sharding.shuffle_to_shards(one, shards=4, blocks=3).collect()
    assert sorted(Counter(r["shard"] for r in rows).values()) == [4, 4, 4, 4]


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in
            spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sharding.op1_shards(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["size"] == len(docs[r["doc_id"]].encode()) + 1 for r in rows)
    assert "Python" not in sharding.op1_shards(
        spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
