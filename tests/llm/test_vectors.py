"""Whitening and hard negatives against plain numpy and by-definition loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import negatives, whitening

SCHEMA = "vec_id long, label int, vector array<double>, score string"


def made(n: int, dims: int, seed: int, wide: float = 0.3) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 3)), [round(float(v), 3) for v in rng.normal(0, wide, dims)], "x") for i in range(n)]
    rows += [rows[10], rows[10], (n, None, rows[3][2], "x"), (n + 1, 1, None, "x"), (n + 2, 1, [*rows[3][2][:-1], None], "x"), (n + 3, 1, [*rows[3][2][:-1], float("nan")], "x")]
    rows += [(n + 4, 1, [*rows[3][2][:-1], float("inf")], "x"), (n + 5, 2, rows[5][2], "x"), (n + 6, 0, rows[5][2], "x"), (n + 7, 0, rows[5][2][:-2], "x"), (None, 1, rows[5][2], "x"), (n + 8, 1, [], "x")]
    return rows


def by_definition(rows, step, scale=256):
    dims = max(len(v) for _, _, v, _ in rows if v)
    ok = [(i, y, [int(np.floor(scale * c)) for c in v] + [0] * (dims - len(v))) for i, y, v, _ in rows if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for a, (i, y, x) in enumerate(ok):
        if i % step:
            continue
        score = [(-sum(p * q for p, q in zip(x, z, strict=True)), j, l) for b, (j, l, z) in enumerate(ok) if b != a]
        same, other = sorted(s for s in score if s[2] == y)[:5], sorted(s for s in score if s[2] != y)
        for p, j, _ in same:
            fits = [s for s in other if 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("wide", "block"), [(0.3, 1 << 20), (0.3, 2000), (400.0, 1 << 20), (30000.0, 1 << 20)])
def test_hard_negatives_are_those_of_the_definition(spark, wide, block):
    rows = made(120, 9, 3, wide)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, block_bytes=block)
    assert sorted(map(tuple, got.collect())) == by_definition(rows, 5)


def test_many_equal_vectors_go_by_vec_id(spark):
    rows = [(i, i % 2, [0.5, 0.25] if i % 3 else [0.4, 0.3], "x") for i in range(300)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(7), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == by_definition(rows, 50)


def test_no_rows_no_anchors_and_vectors_without_entries(spark):
    for rows in ([], [(1, 1, [0.5], "x")], [(50, 1, [], "x"), (51, 1, [], "x"), (52, 2, [], "x")]):
        got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0)
        assert [tuple(r) for r in got.collect()] == ([(50, 51, 1, 52, 0, 0)] if len(rows) == 3 else [])
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_intervals_of_planes_hold_every_score():
    rng = np.random.default_rng(1)
    a, x = rng.integers(-100, 100, (6, 12)).astype(np.float32), rng.integers(-100, 100, (40, 12))
    whole = (a @ x.T.astype(np.float32)).astype(np.int64)
    low = np.sort(whole, axis=1)[:, -4].astype(np.float32)
    row, col, score = negatives.scored(a, x, 7, low, best=4)
    assert set(zip(row, col, strict=True)) == set(zip(*np.nonzero(whole >= low[:, None]), strict=True))
    assert (score == whole[row, col]).all()
    row, col, score = negatives.scored(a, x, 7, np.full(6, -50.0, np.float32), np.full(6, 900.0, np.float32))
    assert set(zip(row, col, strict=True)) == set(zip(*np.nonzero((whole >= -50) & (whole <= 900)), strict=True))


def by_numpy(rows, scale=64):
    dims = max(len(v) for _, _, v, _ in rows if v)
    ok = [(i, [int(np.floor(scale * c)) for c in v] + [0] * (dims - len(v))) for i, _, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in ok], object) + 1_000_000
    u = np.array(sorted({tuple(v) for v in x}), object)
    n, s = len(u), u.sum(axis=0)
    c = ((n * u - s).astype(float)) / n
    w, v = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in ok], n, ((n * x - s) ** 2).sum(axis=1), (n * x - s).astype(float) / n, w[::-1], v[:, ::-1]


def test_whitened_as_by_numpy(spark):
    rows = made(200, 24, 5, 2.0)
    ids, n, deviation, centred, w, v = by_numpy(rows)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5), block=4)
    out = sorted(map(tuple, got.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))
    assert len(out) == 16 * len(ids)
    by = {}
    for r in out:
        by.setdefault(r[1], []).append(r)
    order = sorted(range(len(ids)), key=lambda j: (ids[j] is None, ids[j] or 0))
    for k in range(1, 17):
        mine = np.array([r[4] for r in by[k]])
        plain = (centred @ v[:, k - 1] / np.sqrt(w[k - 1]))[order]
        assert min(abs(mine - plain).max(), abs(mine + plain).max()) < 1e-8
        assert [r[3] for r in by[k]] == [deviation[j] for j in order] and {r[2] for r in by[k]} == {n}
        assert abs(by[k][0][5] - w[k - 1] / w.sum()) < 1e-9 and by[k][0][6] < 1e-9


def test_whitening_of_few_and_flat_vectors(spark):
    schema = "vec_id long, vector array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3 + [(2, None), (3, [None])], schema)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(i, [float(i % 4), 5.0, 2.0 * (i % 4)]) for i in range(40)], schema)).collect()
    assert {r["component"] for r in got} == {1} and {r["n"] for r in got} == {4} and all(abs(r["explained"] - 1) < 1e-12 for r in got)
    assert sorted({round(abs(r["whitened"]), 6) for r in got}) == [0.447214, 1.341641]
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, [])], schema)).collect() == []


@pytest.mark.parametrize("dims", [3, 40, 200])
@pytest.mark.parametrize("kind", ["falling", "repeated", "flat", "thin"])
def test_lanczos_finds_the_largest_pairs(dims, kind):
    rng = np.random.default_rng(dims)
    e = {"falling": 0.8 ** np.arange(dims), "repeated": np.where(np.arange(dims) < dims // 2, 4.0, 1.0), "flat": np.ones(dims), "thin": np.where(np.arange(dims) < 2, 1.0, 0.0)}[kind]
    q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    m = q * e @ q.T
    values, vectors, passes = whitening.lanczos(lambda b: m @ b, dims, 8, block=5)
    wanted = min(8, dims)
    assert np.allclose(values, np.sort(e)[::-1][:wanted], atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(wanted), atol=1e-10) and np.allclose(m @ vectors, vectors * values, atol=1e-11)
    assert passes <= -(-dims // 8) + 1 and (kind != "falling" or dims < 200 or passes < 20)
    assert whitening.lanczos(lambda b: m @ b, dims, 0)[0].size == 0
