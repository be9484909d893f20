"""Neighbour graphs, the stored index, maps and skip-gram embeddings against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import maps, neighbours, skipgram


def rows_of(x, ids=None):
    return [(int(i), [float(v) for v in row]) for i, row in zip(range(len(x)) if ids is None else ids, x, strict=True)]


def clustered(n: int, dims: int, groups: int, seed: int = 3, wide: float = 0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (groups, dims))
    of = rng.integers(0, groups, n)
    return centres[of] + rng.normal(0, wide, (n, dims)), of


def similarities(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T


def test_graph_has_nearly_all_nearest_and_holds_odd_rows_off(spark, tmp_path):
    x, _ = clustered(700, 24, 12)
    rows = [*rows_of(x), (9001, None), (None, [1.0] * 24), (9002, [0.0] * 24), (9003, [1.0, 2.0])]
    got = neighbours.graph(spark.createDataFrame(rows, "id long, vector array<double>").repartition(6), str(tmp_path), 10).collect()
    s = similarities(x)
    np.fill_diagonal(s, -9)
    near = {}
    for r in got:
        near.setdefault(r["id"], set()).add(r["near"])
        assert abs(r["similarity"] - s[r["id"], r["near"]]) < 1e-6
    assert near.keys() == set(range(700)) and {len(v) for v in near.values()} == {10}
    assert np.mean([len(near[i] & set(np.argsort(-s[i])[:10].tolist())) / 10 for i in range(700)]) > 0.93


def test_graph_of_equal_vectors_few_and_none(spark, tmp_path):
    schema = "id long, vector array<float>"
    same = neighbours.graph(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(600)], schema), str(tmp_path / "a"), 5).collect()
    assert len(same) == 3000 and all(abs(r["similarity"] - 1) < 1e-9 and r["id"] != r["near"] for r in same)
    assert {(r["id"], r["near"]) for r in neighbours.graph(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], schema), str(tmp_path / "b"), 5).collect()} == {(1, 2), (2, 1)}
    assert neighbours.graph(spark.createDataFrame([], schema), str(tmp_path / "c"), 5).collect() == []


def test_index_is_stored_and_finds_the_nearest_with_few_comparisons(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    neighbours.build(vectors, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index" / "vectors")).count() == 2000
    layers = {r["layer"]: r["n"] for r in spark.read.parquet(str(tmp_path / "index" / "edges")).groupBy("layer").agg(F.count("id").alias("n")).collect()}
    assert layers[0] == 2000 and sorted(layers) == list(range(len(layers))) and all(layers[i] > 4 * layers[i + 1] for i in range(len(layers) - 1))
    queries = vectors.where("id % 100 = 0").toDF("query_id", "query").unionAll(spark.createDataFrame([(-1, None), (-2, [0.0] * 64)], "query_id long, query array<float>"))
    found = neighbours.search(spark, str(tmp_path / "index"), queries, str(tmp_path / "found")).collect()
    pd = vectors.toPandas()
    ids, s = pd["id"].to_numpy(), np.round(similarities(np.stack(pd["vector"]).astype(float)), 6)
    hits, compared = [], []
    for q in ids[ids % 100 == 0]:
        own = sorted((r["rank"], r["id"], r["compared"]) for r in found if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 11)) and own[0][1] == q
        hits.append(len({r[1] for r in own} & set(ids[np.lexsort((ids, -s[np.nonzero(ids == q)[0][0]]))[:10]].tolist())) / 10)
        compared.append(own[0][2])
    assert {r["query_id"] for r in found} == set(ids[ids % 100 == 0].tolist())
    assert np.mean(hits) >= 0.9 and np.mean(compared) < 0.2 * len(ids)


def test_curve_and_weights(spark):
    a, b = maps.curve(0.1)
    assert abs(a - 1.577) < 0.05 and abs(b - 0.895) < 0.02
    edges = [(1, 2, 0.9), (1, 3, 0.5), (2, 1, 0.9), (2, 3, 0.8), (3, 2, 0.8), (3, 1, 0.5)]
    got = {(r["a"], r["b"]): r["weight"] for r in maps.weights(spark.createDataFrame(edges, "id long, near long, similarity double")).collect()}
    # Each node's nearest has weight one and what is left to log2(2) = 1 is nothing, so unions are one or nearly none.
    assert got[1, 2] == pytest.approx(1) and got[2, 3] == pytest.approx(1) and got[1, 3] < 0.01


def test_map_keeps_neighbours_together(spark, tmp_path):
    x, of = clustered(400, 20, 5)
    df = spark.createDataFrame([*rows_of(x), (9001, None)], "id long, vector array<double>").repartition(4)
    got = {r["id"]: (r["x"], r["y"]) for r in maps.neighbour_map(df, str(tmp_path / "a"), 10, rounds=4).collect()}
    assert got.keys() == set(range(400))
    p = np.array([got[i] for i in range(400)])
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near, k = np.argsort(d, axis=1)[:, :10], 10
    assert (of[near] == of[:, None]).mean() > 0.95
    s = similarities(x)
    np.fill_diagonal(s, 9)
    rank = np.argsort(np.argsort(-s, axis=1), axis=1)
    trust = 1 - 2 / (400 * k * (2 * 400 - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, axis=1) - k, 0).sum()
    assert trust > 0.85
    again = {r["id"]: (r["x"], r["y"]) for r in maps.neighbour_map(df, str(tmp_path / "b"), 10, rounds=4).collect()}
    assert all(np.allclose(got[i], again[i], atol=1e-6) for i in got)


def test_window_pairs_stay_within_their_windows(spark):
    rows = [(s, list(range(100 * s, 100 * s + n))) for s, n in ((1, 12), (2, 1), (3, 0), (4, 5))]
    got = [(r["c"], r["o"]) for r in skipgram.window_pairs(spark.createDataFrame(rows, "sequence long, tokens array<int>"), 3).collect()]
    assert len(got) == len(set(got)) and all(c // 100 == o // 100 and 1 <= abs(c - o) <= 3 for c, o in got)
    assert {(c, c + 1) for s, n in ((1, 12), (4, 5)) for c in range(100 * s, 100 * s + n - 1)} <= set(got)


@pytest.mark.parametrize("block", [skipgram.BLOCK_WORDS, 20])
def test_words_of_one_company_end_up_close(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(skipgram, "BLOCK_WORDS", block)
    rng = np.random.default_rng(1)
    rows = [(i, [f"g{i % 4}w{j}" for j in rng.integers(0, 15, 8)] + ([None] if i % 9 == 0 else [])) for i in range(1200)]
    rows += [(5000, None), (5001, []), (5002, ["seldom", "seldom"])]
    df = spark.createDataFrame(rows, "sequence long, tokens array<string>")
    got = {r["word"]: np.array(r["vector"]) for r in skipgram.skip_gram(df, str(tmp_path), 16, 5, 5, passes=3, often=1.0, rate=0.05).collect()}
    assert got.keys() == {f"g{g}w{j}" for g in range(4) for j in range(15)} and {len(v) for v in got.values()} == {16}
    names = sorted(got)
    s, of = similarities(np.stack([got[w] for w in names])), np.array([w[:2] for w in names])
    np.fill_diagonal(s, np.nan)
    same = of[:, None] == of[None]
    assert np.nanmean(s[same]) > np.nanmean(s[~same]) + 0.3
    assert np.mean([of[np.nanargmax(row)] == g for row, g in zip(s, of, strict=True)]) > 0.9
    assert skipgram.skip_gram(spark.createDataFrame([], df.schema), str(tmp_path / "none")).collect() == []
