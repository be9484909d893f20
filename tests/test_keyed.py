"""Keyed tables, the edge table and seed-first edges, the search from both ends."""

from __future__ import annotations

import os
from itertools import pairwise

import numpy as np
import pytest

from basketry.operators import graph
from basketry.sources import keyed


def files(path):
    return {f"{d}/{n}" for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_upsert_twice_rewrites_touched_buckets_only(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, s string, v int"
    change = lambda rows, batch: keyed.change(spark.createDataFrame(rows, schema), path, ["k"], keyed.latest(["v"]), batch)
    change([(i, "a", i) for i in range(500)] + [(None, "x", 1)], "one")
    before = files(path)
    state = change([(7, "b", 70), (7, "b", 71), (7, "c", None), (900, "new", 9)], "two")
    assert before < files(path) and state["version"] == 2
    moved = {b for b, f in state["folders"].items() if f.startswith("version=2")}
    assert 1 <= len(moved) <= 2 and len(state["folders"]) == keyed.BUCKETS
    held = files(path)
    assert change([(7, "z", 99)], "two") == state and files(path) == held
    want = {i: ("a", i) for i in range(500)} | {7: ("b", 71), 900: ("new", 9)}
    assert {r["k"]: (r["s"], r["v"]) for r in keyed.read(spark, path).collect()} == want
    found = keyed.lookup(spark, path, [(7,), (12,), (-5,)])
    assert {r["k"]: (r["s"], r["v"]) for r in found.collect()} == {7: ("b", 71), 12: ("a", 12)} and found.columns == ["k", "s", "v"]


def test_a_version_is_published_once(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.change(spark.createDataFrame([(1, 1)], "k long, v int"), path, ["k"], keyed.latest(["v"]), "one")
    with pytest.raises(RuntimeError):
        keyed._publish(spark, path, keyed.manifest(spark, path) | {"batches": []})
    assert keyed.manifest(spark, path)["batches"] == ["one"] and keyed.manifest(spark, str(tmp_path / "none")) is None


def baskets(spark, n=300, nodes=25, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(p, int(v)) for p in range(n) for v in rng.integers(0, nodes, int(rng.integers(1, 7)))] + [(5, None), (None, 3)]
    return spark.createDataFrame(rows, "pid long, node long")


def test_edges_of_seeds_are_those_of_the_whole_graph(spark):
    rows = baskets(spark)
    whole = {tuple(r) for r in graph.cooccurrence(rows, "pid", "node", 2).collect()}
    for seeds in ([3], [3, 4, 24], [99]):
        got = [tuple(r) for r in graph.seed_edges(rows, "pid", "node", seeds, 2).collect()]
        assert len(got) == len(set(got)) and set(got) == {e for e in whole if set(e[:2]) & set(seeds)}


def test_edge_table_in_batches_equals_one_count_and_is_read_by_bucket(spark, tmp_path):
    rows, path = baskets(spark), str(tmp_path / "edges")
    for batch, some in (("a", "pid < 100"), ("b", "pid >= 100 AND pid < 120"), ("a", "pid < 100"), ("c", "pid >= 120")):
        graph.keep_edges(rows.where(some), "pid", "node", path, batch)
    whole = {tuple(r) for r in graph.cooccurrence(rows, "pid", "node").collect()}
    assert {tuple(r) for r in keyed.read(spark, path).collect()} == whole | {(b, a, w) for a, b, w in whole}
    for seeds in ([3], [3, 4, 24], [99]):
        got = [tuple(r) for r in graph.kept_edges(spark, path, seeds).collect()]
        assert len(got) == len(set(got)) and set(got) == {e for e in whole if set(e[:2]) & set(seeds)}
    plan = graph.kept_edges(spark, path, [3])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(src,3)" in plan.partition("PushedFilters: ")[2]
    opened = keyed.lookup(spark, path, [(3,)]).inputFiles()
    assert 0 < len(opened) < len(keyed.read(spark, path).inputFiles())


def by_levels(links, start, goal, deep):
    """The smallest shortest path by node order."""
    level = {start: [start]}
    seen = {start}
    for _ in range(deep):
        if goal in level:
            break
        step = {}
        for n, path in level.items():
            for m in links.get(n, ()):
                if m not in seen and (m not in step or [*path, m] < step[m]):
                    step[m] = [*path, m]
        seen |= set(step)
        level = step
    return level.get(goal)


@pytest.mark.parametrize("seed", range(3))
def test_paths_from_both_ends(spark, seed):
    rng = np.random.default_rng(seed)
    edges = {(min(a, b), max(a, b)): int(w) for a, b, w in zip(rng.integers(0, 40, 70), rng.integers(0, 40, 70), rng.integers(1, 9, 70), strict=True) if a != b}
    df = spark.createDataFrame([(int(a), int(b), w) for (a, b), w in edges.items()], "a long, b long, weight long")
    links = {}
    for (a, b), w in edges.items():
        links.setdefault(int(a), []).append((-w, int(b)))
        links.setdefault(int(b), []).append((-w, int(a)))
    links = {n: [m for _, m in sorted(x)[:3]] for n, x in links.items()}
    for start, goal in ((0, 7), (3, 30), (12, 12), (5, 99)):
        got = sorted((r["hop"], r["node"], r["shared"]) for r in graph.six_degrees(spark, df, start, goal, 6, 3).collect())
        want = by_levels(links, start, goal, 6)
        assert [n for _, n, _ in got] == (want or [])
        assert [s for _, _, s in got][1:] == [edges[min(p), max(p)] for p in pairwise(want or [])]
