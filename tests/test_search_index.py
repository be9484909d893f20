"""The stored inverted index against counts by hand."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from basketry.operators import search_index


def test_blocks_tokens_and_searches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "SPAN", 16)
    rng, path = np.random.default_rng(4), str(tmp_path / "index")
    words = ["red", "Redwood", "blue", "a1", "stone", "über", "x"]
    rows = [(int(i) - 40, " ".join(rng.choice(words, int(rng.integers(0, 9))))) for i in rng.permutation(120) * 3] + [(7000, None), (None, "red"), (8000, "")]
    search_index.store(spark.createDataFrame(rows, "id long, text string").repartition(3), path)
    count = {i: Counter(re.findall("[a-z0-9]+", t.lower())) for i, t in rows if t is not None and i is not None}
    every = {w for c in count.values() for w in c}
    got = {r["token"]: (r["texts"], r["times"]) for r in search_index.tokens(spark, path).collect()}
    assert got == {w: (sum(w in c for c in count.values()), sum(c[w] for c in count.values())) for w in every}
    lengths = {r["id"]: r["tokens"] for r in spark.read.parquet(f"{path}/lengths").collect()}
    assert lengths == {i: sum(c.values()) for i, c in count.items() if c}
    found = search_index.postings(spark, path, ["red", "stone", "nowhere"])
    assert {(r["token"], r["id"]): r["n"] for r in found.collect()} == {(w, i): c[w] for i, c in count.items() for w in ("red", "stone") if c[w]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(token" in plan
    ranks = spark.createDataFrame([(i, abs(i) % 5) for i in count if i % 2], "id long, rank int")
    order = lambda s: sorted(s, key=lambda x: (-x[1], abs(x[0]) % 5 if x[0] % 2 else 99, x[0]))[:10]
    ask = lambda q, prefix=False: [(r["id"], r["score"]) for r in search_index.search(spark, path, ranks, q, 10, prefix).collect()]
    assert ask("Stone red") == order([(i, c["red"] + c["stone"]) for i, c in count.items() if c["red"] and c["stone"]])
    assert ask("blue re", True) == order([(i, c["blue"] + c["red"] + c["redwood"]) for i, c in count.items() if c["blue"] and c["red"] + c["redwood"]])
    assert ask("red nowhere") == [] and ask("!!") == [] and ask("", True) == []
