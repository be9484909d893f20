"""A map of vectors in the plane that keeps neighbours together.

The neighbour graph's edges become weights, near ones of each node up to one and farther ones falling off at the node's own scale, and the two
directions of an edge are united. Nodes start at their two principal components. In a round they are dealt into blocks, other ones each time; a
block moves its nodes by some steps along sampled edges, towards the neighbour (which stands still unless it is in the block) and away from drawn nodes
of the block. A round is one join of edges with places and one pass over blocks of bounded size, however large the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import delete, scratch, ship, written
from . import neighbours

#: Nodes of a block (on average), rounds, steps of a block in a round, nodes that one is driven from for each neighbour, rounds of the scale's bisection.
BLOCK, ROUNDS, STEPS, DRIVEN, HALVINGS = 20_000, 8, 25, 5, 60


def curve(least: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b for which 1 / (1 + a d^2b) is closest to 1 up to the distance least and to exp(-(d - least) / spread) beyond."""
    d = np.linspace(0.01, 3 * spread, 300)
    wanted = np.where(d < least, 1.0, np.exp(-(d - least) / spread))
    v = np.zeros(2)  # logarithms of a and b
    for _ in range(100):
        a, b = np.exp(v)
        power = a * d ** (2 * b)
        made = 1 / (1 + power)
        by = -(made**2 * power)[:, None] * np.stack([np.ones_like(d), 2 * b * np.log(d)], axis=1)
        v += np.linalg.lstsq(by, wanted - made, rcond=None)[0] * 0.5
    return float(np.exp(v[0])), float(np.exp(v[1]))


def weights(edges: DataFrame) -> DataFrame:
    """(a, b, weight), a < b, of edges (id, near, similarity): each node's own weights exp(-(d - nearest) / scale), the scale such that they add up to the
    logarithm of their number, and of two directions x and y the union x + y - xy."""

    def own(frames):
        for rows in frames:
            n = rows["near"].map(len).to_numpy()
            d = np.full((len(rows), n.max(initial=1)), np.inf)
            for i, (s, m) in enumerate(zip(rows["similarity"], n, strict=True)):
                d[i, :m] = np.maximum(1 - np.asarray(s), 0)
            positive = np.where(d > 0, d, np.inf).min(axis=1)
            gap = np.maximum(d - np.where(np.isfinite(positive), positive, 0)[:, None], 0)
            low, high = np.zeros(len(rows)), np.full(len(rows), 1e3)
            for _ in range(HALVINGS):
                scale = (low + high) / 2
                over = np.exp(-gap / np.maximum(scale, 1e-12)[:, None]).sum(axis=1) > np.log2(np.maximum(n, 2))
                high, low = np.where(over, scale, high), np.where(over, low, scale)
            w = np.exp(-gap / np.maximum((low + high) / 2, 1e-3 * np.where(np.isfinite(d), d, 0).sum(axis=1) / np.maximum(n, 1) + 1e-12)[:, None])
            at = np.repeat(np.arange(len(rows)), n)
            yield pd.DataFrame({"id": rows["id"].to_numpy()[at], "near": np.concatenate(rows["near"].to_list() or [[]]).astype(np.int64), "w": w[np.isfinite(d)]})

    lists = edges.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("near", "similarity"))).alias("x")).select("id", F.col("x.near").alias("near"), F.col("x.similarity").alias("similarity"))
    each = lists.mapInPandas(own, "id long, near long, w double")
    both = each.groupBy(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).agg(F.sum("w").alias("s"), F.max("w").alias("m"), F.count(F.lit(1)).alias("n"))
    return both.select("a", "b", F.when(F.col("n") == 1, F.col("s")).otherwise(F.col("s") - F.col("m") * (F.col("s") - F.col("m"))).alias("weight"))


def _principal(vectors: DataFrame, seed: int) -> DataFrame:
    """(id, x, y): two principal components, from -10 to 10, and a little noise by hash that parts equal vectors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("id", array_to_vector("vector").alias("features"))
    xy = PCA(k=2, inputCol="features", outputCol="xy").fit(rows).transform(rows).select("id", vector_to_array("xy").alias("xy"))
    far = xy.agg(F.max(F.greatest(F.abs(F.col("xy")[0]), F.abs(F.col("xy")[1])))).first()[0] or 1.0
    noise = lambda i: (F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(10_000)) / 10_000 - 0.5) * 0.02
    return xy.select("id", *((F.col("xy")[i] * (10 / far) + noise(i)).alias(c) for i, c in enumerate("xy")))


def _move(at: np.ndarray, node: np.ndarray, inner: np.ndarray, other: np.ndarray, weight: np.ndarray, a: float, b: float, rates: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The places at after the steps of a round: edges from node, to the node inner or, where that is -1, to a fixed place other."""
    n = len(at)
    add = lambda i, v: np.stack([np.bincount(i, v[:, k], n) for k in (0, 1)], axis=1)
    for rate in rates:
        taken = np.nonzero(rng.random(len(node)) < weight)[0]
        i, j = node[taken], inner[taken]
        gap = at[i] - np.where((j >= 0)[:, None], at[j], other[taken])
        d = (gap**2).sum(axis=1)
        pull = np.where(d > 0, -2 * a * b * np.maximum(d, 1e-12) ** (b - 1) / (1 + a * d**b), 0)
        change = add(i, np.clip(pull[:, None] * gap, -4, 4))
        i = np.repeat(i, DRIVEN)
        j = rng.integers(0, n, len(i))
        gap = at[i] - at[j]
        d = (gap**2).sum(axis=1)
        push = np.where(i == j, 0, 2 * b / ((0.001 + d) * (1 + a * d**b)))
        change += add(i, np.clip(push[:, None] * gap, -4, 4))
        at = at + rate * np.clip(change, -4, 4)
    return at


def _stepped(n: int, rates: np.ndarray, a: float, b: float, seed: int):
    """A block's nodes (id, x, y; near, weight, tx, ty of their edges) after the steps of round n."""

    def step(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        ids = rows["id"].to_numpy()
        some = [i for i, x in enumerate(rows["near"]) if x is not None]
        held = rows.iloc[some]
        flat = lambda c, kind: np.concatenate([np.asarray(x, kind) for x in held[c]]) if some else np.empty(0, kind)
        near = flat("near", np.int64)
        node = np.repeat(some, [len(x) for x in held["near"]]).astype(np.int64)
        place = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
        inner = np.where(ids[place] == near, place, -1)
        other = np.stack([flat("tx", float), flat("ty", float)], axis=1)
        moved = _move(rows[["x", "y"]].to_numpy(), node, inner, other, flat("weight", float), a, b, rates, np.random.default_rng((seed, n, key[0])))
        return pd.DataFrame({"id": ids, "x": moved[:, 0], "y": moved[:, 1]})

    return step


def neighbour_map(vectors: DataFrame, at: str, k: int = 15, least: float = 0.1, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """(id, x, y): a place in the plane for each vector (id, vector), neighbours by cosine near each other. The rows are read from the folder at.

    least: the distance at which close nodes settle. Null and zero vectors and those of another length than most have no place; a node without neighbours
    (the only one) stays where it began. The same rows, seed and number of tasks of the neighbour graph give the same map.
    """
    spark = ship(vectors.sparkSession)
    a, b = curve(least)
    with scratch(spark, "map") as work:
        edges = neighbours.graph(vectors, f"{work}/graph", k, seed=seed)
        unit = neighbours.unit_vectors(vectors)
        length = unit.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if length is None:
            return spark.createDataFrame([], "id long, x double, y double")
        unit = unit.where(F.size("vector") == length["d"])
        whole = unit.count()
        if length["d"] < 2 or whole < 3:
            return written(unit.select("id", F.element_at("vector", 1).alias("x"), F.lit(0.0).alias("y")), f"{at}/places")
        united = weights(edges)
        ways = united.select(F.col("a").alias("id"), F.col("b").alias("near"), "weight").unionAll(united.select(F.col("b").alias("id"), F.col("a").alias("near"), "weight"))
        r = F.row_number().over(W.partitionBy("id").orderBy(F.desc("weight"), "near"))
        ways = written(ways.withColumn("r", r).where(F.col("r") <= 2 * k).select("id", "near", "weight"), f"{work}/ways")
        places = written(_principal(unit, seed), f"{work}/places-0")
        blocks = max(1, -(-whole // BLOCK))
        for n in range(rounds):
            rates = 1 - np.arange(n * STEPS, (n + 1) * STEPS) / (rounds * STEPS)
            ends = ways.join(places.select(F.col("id").alias("near"), F.struct("x", "y").alias("to")), "near").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("near", "weight", "to"))).alias("e"))
            rows = places.join(ends, "id", "left").withColumn("block", F.pmod(F.xxhash64("id", F.lit(n)), F.lit(blocks)).cast("int"))
            rows = rows.select("block", "id", "x", "y", F.col("e.near").alias("near"), F.col("e.weight").alias("weight"), F.col("e.to.x").alias("tx"), F.col("e.to.y").alias("ty"))
            places = written(rows.groupBy("block").applyInPandas(_stepped(n, rates, a, b, seed), "id long, x double, y double"), f"{work}/places-{n + 1}")
            delete(spark, f"{work}/places-{n}")
        return written(places, f"{at}/places")
