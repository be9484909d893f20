"""Weighted co-occurrence graphs of nodes that share baskets."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import scratch, tasks, written
from ..sources import keyed
from .stats import ladder

# What the shared share, and the number of shared baskets, of two nodes say.
OVERLAPS = [(30, "highly_entangled"), (15, "frequent_companions"), (5, "occasional_neighbors"), (0, "parallel_universes")]
COLLISIONS = [(10_000, "direct_collision"), (2_000, "frequent_proximity"), (500, "occasional_contact"), (0, "parallel_orbits")]


def cooccurrence(rows: DataFrame, basket: str, node: str, min_shared: int = 1, top: int | None = None) -> DataFrame:
    """(a, b, weight), a < b: baskets that both nodes are in, for pairs with at least min_shared.

    With top only the top nodes by reach take part (ties by node); they are a small list whose size is
    top, so the semi-join may be broadcast. A basket's nodes are made distinct before pairs are formed.
    """
    # Dealt out by basket first: rows are made distinct, joined and counted in shares of one size.
    pairs = rows.select(F.col(basket).alias("pid"), F.col(node).alias("node")).where(F.col("node").isNotNull())
    pairs = pairs.repartition(tasks(rows), "pid").distinct()
    if top is not None:
        kept = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(top).select("node")
        pairs = pairs.join(F.broadcast(kept) if top <= 100_000 else kept, "node", "left_semi")
    other = pairs.select("pid", F.col("node").alias("b"))
    joined = pairs.withColumnRenamed("node", "a").join(other, "pid").where("a < b")
    return joined.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_shared)


def seed_edges(rows: DataFrame, basket: str, node: str, seeds: list, min_shared: int = 1) -> DataFrame:
    """(a, b, weight) as from cooccurrence, but only the edges that a seed has: the seeds' baskets first, then what else lies in them.

    Rows of other baskets go in a semi-join before anything is made distinct, and the pairs are seed by node, so the work is that of the
    seeds' baskets. seeds is a short list.
    """
    seeds = list(seeds)
    held = rows.select(F.col(basket).alias("pid"), F.col(node).alias("node")).where(F.col("node").isNotNull())
    mine = held.where(F.col("node").isin(seeds)).distinct()
    near = held.join(mine.select("pid").distinct(), "pid", "left_semi").distinct()
    seed = F.col("seed")
    # Of two seeds each basket counts once.
    met = near.join(mine.withColumnRenamed("node", "seed"), "pid").where((F.col("node") != seed) & (~F.col("node").isin(seeds) | (seed < F.col("node"))))
    pairs = met.groupBy(F.least("node", "seed").alias("a"), F.greatest("node", "seed").alias("b"))
    return pairs.agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_shared)


def keep_edges(rows: DataFrame, basket: str, node: str, path: str, batch: str) -> None:
    """Add the co-occurrence of a batch of new baskets to the edge table at path (src, dst, weight; both directions, in buckets by src). A batch whose
    baskets were added before under the same name adds nothing."""
    edges = symmetric(cooccurrence(rows, basket, node))
    keyed.change(edges, path, ["src", "dst"], keyed.summed("weight"), batch, by=["src"])


def kept_edges(spark: SparkSession, path: str, nodes: list) -> DataFrame:
    """(a, b, weight) of the edges that the given nodes have, read from their buckets of the edge table alone."""
    found = keyed.lookup(spark, path, [(n,) for n in nodes])
    one = ~F.col("dst").isin(list(nodes)) | (F.col("src") < F.col("dst"))
    return found.where(one).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) in both directions."""
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return edges.select(F.explode(ends).alias("e"), "weight").select("e.src", "e.dst", "weight")


def endpoints(edges: DataFrame) -> DataFrame:
    """(node): every node that has an edge, once."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def neighbours(edges: DataFrame, seeds: list, fan: int | None = None) -> DataFrame:
    """(src, dst, weight): the neighbours of the seeds, the fan strongest of each (ties by dst)."""
    found = symmetric(edges).where(F.col("src").isin(list(seeds)))
    if fan is None:
        return found
    r = F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return found.withColumn("r", r).where(F.col("r") <= fan).drop("r")


def compass(edges: DataFrame, node, k: int = 12) -> DataFrame:
    """The k strongest neighbours of a node, with their strength relative to the strongest."""
    return neighbours(edges, [node], k).select(
        F.col("dst").alias("neighbour"), "weight", F.round(F.col("weight") * 1.0 / F.max("weight").over(W.partitionBy("src")), 3).alias("strength")
    )


def overlap(edges: DataFrame, counts: DataFrame, pairs: list[tuple]) -> DataFrame:
    """For given pairs: shared baskets, their share of the smaller reach, and a verdict."""
    wanted = reduce(or_, ((F.col("a") == F.lit(min(p))) & (F.col("b") == F.lit(max(p))) for p in pairs), F.lit(False))
    reach = counts.select(F.col("owner"), "basket_count")
    found = edges.where(wanted).join(reach.toDF("a", "ca"), "a").join(reach.toDF("b", "cb"), "b")
    pct = F.round(F.col("weight") * 100.0 / F.greatest(F.least("ca", "cb"), F.lit(1)), 2)
    return found.select("a", "b", F.col("weight").alias("shared"), pct.alias("overlap_pct")).withColumn("verdict", ladder(F.col("overlap_pct"), OVERLAPS))


def collision(edges: DataFrame, counts: DataFrame, a, b, k: int = 8) -> DataFrame:
    """The k common neighbours of a and b with the greatest harmonic mean of their weights."""
    near = neighbours(edges, [a, b]).where(~F.col("dst").isin([a, b]))
    both = near.groupBy("dst").agg(
        F.max(F.when(F.col("src") == a, F.col("weight"))).alias("wa"), F.max(F.when(F.col("src") == b, F.col("weight"))).alias("wb")
    ).where("wa IS NOT NULL AND wb IS NOT NULL")
    score = F.round(2.0 * F.col("wa") * F.col("wb") / (F.col("wa") + F.col("wb")), 1)
    joined = both.withColumn("score", score).join(counts, F.col("dst") == F.col("owner"))
    return joined.orderBy(F.desc("score"), F.desc("basket_count"), "dst").limit(k).select(F.col("dst").alias("bridge"), "wa", "wb", "score", "basket_count")


def collision_verdict(edges: DataFrame, a, b) -> DataFrame:
    """One row: the baskets that a and b share (0 without an edge), how many neighbours they have in common, and a verdict."""
    near = neighbours(edges, [a, b])
    shared = near.agg(F.coalesce(F.max(F.when((F.col("src") == F.lit(a)) & (F.col("dst") == F.lit(b)), F.col("weight"))), F.lit(0)).alias("shared"))
    common = near.where(~F.col("dst").isin([a, b])).groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n = 2").agg(F.count(F.lit(1)).alias("bridge_count"))
    return shared.crossJoin(common).withColumn("verdict", ladder(F.col("shared"), COLLISIONS))


def common_ground(edges: DataFrame, seeds: list) -> DataFrame:
    """One row: the nodes that blend takes from, all neighbours of the seeds (seeds among them), and the first's share of the second."""
    n = len(seeds)
    per = neighbours(edges, seeds).groupBy("dst").agg(F.count(F.lit(1)).alias("hits"))
    other = ~F.col("dst").isin(list(seeds))
    counts = per.agg(F.count_if(other & (F.col("hits") == n)).alias("full"), F.count_if(other & (F.col("hits") >= max(1, n // 2))).alias("some"), F.count(F.lit(1)).alias("neighbours"))
    common = F.when(F.col("full") > 0, F.col("full")).otherwise(F.col("some"))
    return counts.select(common.alias("common"), "neighbours", F.round(common * 100.0 / F.greatest("neighbours", F.lit(1)), 1).alias("pct"))


def blend_items(blended: DataFrame, top_items: DataFrame, per: int = 2, most: int = 12) -> DataFrame:
    """(rank, title, node, blend_score): the first per titles (owner, top_items) of each blended node in turn, until there are most.

    Blended nodes are few, so they are numbered in one task.
    """
    few = blended.join(top_items, F.col("node") == F.col("owner")).withColumn("few", F.slice("top_items", 1, per))
    before = F.coalesce(F.sum(F.size("few")).over(W.orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = few.withColumn("before", before).where(F.col("before") < most)
    return taken.select("before", "node", "blend_score", F.posexplode("few").alias("i", "title")).select((F.col("before") + F.col("i") + 1).alias("rank"), "title", "node", "blend_score")


def blend(edges: DataFrame, seeds: list, k: int = 10) -> DataFrame:
    """The k nodes that blend the seeds best: common neighbours by n-ary harmonic mean of their weights.

    Where no node neighbours all seeds, those of at least half of them take part, with score 0. Scores are
    relative to the best one, or to 1 where that is less. place counts them from 1.
    """
    n = len(seeds)
    found = neighbours(edges, seeds).where(~F.col("dst").isin(list(seeds)))
    per = found.groupBy("dst").agg(F.count(F.lit(1)).alias("hits"), F.sum(1.0 / F.col("weight")).alias("inverse"))
    full = per.select(F.max((F.col("hits") == n).cast("int")).alias("full"))
    pool = per.crossJoin(F.broadcast(full)).where(F.when(F.col("full") == 1, F.col("hits") == n).otherwise(F.col("hits") >= max(1, n // 2)))
    scored = pool.withColumn("h", F.when(F.col("hits") == n, n / F.col("inverse")).otherwise(0.0))
    top = scored.select(F.greatest(F.max("h"), F.lit(1.0)).alias("top"))
    order = [F.desc(F.round("h", 6)), F.col("dst")]
    best = scored.crossJoin(F.broadcast(top)).orderBy(*order).limit(k).withColumn("place", F.row_number().over(W.orderBy(*order)).cast("bigint"))
    return best.select("place", F.col("dst").alias("node"), F.col("hits").cast("bigint").alias("hits"), F.round(F.col("h") / F.col("top"), 3).alias("blend_score"))


def strongest(edges: DataFrame, fan: int) -> DataFrame:
    """(src, dst, weight): each node's fan strongest edges (ties by dst)."""
    r = F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return symmetric(edges).withColumn("r", r).where(F.col("r") <= fan).drop("r")


def six_degrees(spark: SparkSession, edges: DataFrame, start, goal, max_depth: int = 6, fan: int = 100) -> DataFrame:
    """(hop, node, shared): a shortest path within each node's fan strongest edges, by a search from both ends.

    Each side has a table of the nodes that it has met, with the smallest path (by node order) to them. The side that has met fewer nodes goes one
    level on: from start along the links, from goal against them. When the two depths add up to the distance the sides meet; of the meeting
    nodes' whole paths the smallest wins. Levels are written to the shared folder and gone when the path is found. No path
    within max_depth: no rows. start = goal: hop 0 alone.
    """
    kind = edges.schema["a"].dataType.simpleString()
    with scratch(spark, "paths") as at:
        links = written(strongest(edges, fan).select("src", "dst"), f"{at}/links")
        ends = [(F.col("src"), F.col("dst"), lambda path, to: F.concat(path, F.array(to))), (F.col("dst"), F.col("src"), lambda path, to: F.concat(F.array(to), path))]
        met = [spark.createDataFrame([(n, [n], 0)], f"node {kind}, path array<{kind}>, depth int") for n in (start, goal)]
        depth, size = [0, 0], [1, 1]
        best = [start] if start == goal else None
        while best is None and sum(depth) < max_depth:
            side = 0 if size[0] <= size[1] else 1
            near, far, longer = ends[side]
            level = met[side].where(F.col("depth") == depth[side])
            step = level.join(links.select(near.alias("node"), far.alias("to")), "node").select(F.col("to").alias("node"), longer(F.col("path"), F.col("to")).alias("path"))
            depth[side] += 1
            fresh = step.join(met[side].select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
            fresh = written(fresh.withColumn("depth", F.lit(depth[side])), f"{at}/{side}-{depth[side]}")
            n = fresh.count()
            if not n:
                break
            size[side] += n
            met[side] = met[side].unionByName(fresh)
            both = fresh.select("node", F.col("path").alias("one")).join(met[1 - side].select("node", F.col("path").alias("two")), "node")
            one, two = (F.col("one"), F.col("two")) if side == 0 else (F.col("two"), F.col("one"))
            best = both.select(F.concat(one, F.slice(two, 2, F.size(two))).alias("path")).agg(F.min(F.struct(F.size("path"), "path")).alias("x")).first()["x"]
            best = best and list(best["path"])
    path = spark.createDataFrame([(i, n, best[i - 1] if i else None) for i, n in enumerate(best or [])], f"hop bigint, node {kind}, before {kind}")
    shared = symmetric(edges.where(F.col("a").isin(best or []) & F.col("b").isin(best or [])))
    both = shared.select(F.col("src").alias("before"), F.col("dst").alias("node"), F.col("weight").alias("shared"))
    return path.join(both, ["before", "node"], "left").select("hop", "node", "shared")


def tag_ancestry(tags: DataFrame, counts: DataFrame, subject, limit: int = 5, least: float = 0.05, keep: int = 60) -> DataFrame:
    """Owners with tags in common with the subject, by Jaccard similarity, as ancestors (reach over 1.2 times its own),
    descendants (under 0.8 times) or peers; those past limit of the first two are peers too.

    tags: (owner, tag). Only owners that share a tag are met, through the tags, never all pairs.
    """
    own = tags.where(F.col("owner") == F.lit(subject)).select("tag")
    sizes = tags.groupBy("owner").agg(F.countDistinct("tag").alias("size"))
    n = own.agg(F.countDistinct("tag").alias("own"))
    common = tags.where(F.col("owner") != F.lit(subject)).distinct().join(own.distinct(), "tag").groupBy("owner").agg(
        F.count(F.lit(1)).alias("common"), F.slice(F.array_sort(F.collect_set("tag")), 1, 4).alias("shared_tags")
    )
    sim = F.col("common") * 1.0 / (F.col("size") + F.col("own") - F.col("common"))
    scored = common.join(sizes, "owner").crossJoin(F.broadcast(n)).withColumn("similarity", F.round(sim, 4)).where(sim >= least)
    base = counts.where(F.col("owner") == F.lit(subject)).select(F.col("basket_count").alias("base"))
    best = scored.join(counts, "owner").crossJoin(F.broadcast(base)).orderBy(F.desc("similarity"), "owner").limit(keep)
    side = F.when(F.col("basket_count") > 1.2 * F.col("base"), "ancestor").when(F.col("basket_count") < 0.8 * F.col("base"), "descendant").otherwise("peer")
    best = best.withColumn("side", side)
    r = F.row_number().over(W.partitionBy("side").orderBy(F.desc("similarity"), "owner"))
    return best.withColumn("r", r).select(
        "owner", "similarity", "shared_tags", F.when(F.col("r") > limit, "peer").otherwise(F.col("side")).alias("side")
    )
