"""Neighbour graphs of vectors, and a navigable index of them that is stored, read back and searched.

A graph is found by neighbour descent: vectors that lie together in the order of some random projection are compared in blocks, and
then, round after round, a node's neighbours (those it names and those that name it) are compared with each other, since a neighbour of a neighbour
is likely one. The index has such a graph for all vectors and one for each thinner layer above; a search descends from the few nodes of
the top, as a beam that is a table of all queries at once. Every step is a join of tables by node, so no node, query or shard has to hold a graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import delete, scratch, ship, written
from .vectors import normalize

#: Neighbours of a node, projections whose order the first ones come from, vectors of a block, rounds of descent at most.
K, ORDERS, BLOCK, ROUNDS = 10, 4, 128, 12
#: Neighbours that a node has while the graph is being found: short lists lead nowhere where vectors have many dimensions.
WIDE = 24
#: Part of the edges that has to change for another round.
STILL = 0.01
#: One vector in so many is in the next layer, and a layer of so many or fewer is the top.
THINNER, TOP = 16, 64
#: Beam of a search, nodes that a query expands in a round.
EF, EXPANDED = 20, 5
EDGE = "id long, near long, similarity double"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.empty((0, 0))


def _best(ids: np.ndarray, own: np.ndarray, similarity: np.ndarray, k: int, least: np.ndarray | None = None) -> pa.RecordBatch:
    """For the node of each row the k most similar of the columns' nodes, itself left out, and those that are less similar than its least."""
    similarity = np.where(own[:, None] == ids[None], -np.inf, similarity)
    k = min(k, len(ids))
    at = np.argpartition(-similarity, k - 1, axis=1)[:, :k]
    row, col = np.repeat(np.arange(len(own)), k), at.ravel()
    value = np.round(similarity[row, col], 9)
    ok = np.isfinite(value) if least is None else np.isfinite(value) & (value >= least[row])
    return pa.RecordBatch.from_arrays([pa.array(own[row[ok]]), pa.array(ids[col[ok]]), pa.array(value[ok])], ["id", "near", "similarity"])


def _blocks(k: int):
    """Each vector's nearest among those of its block, blocks being runs of rows of a task; half a block is seen with the one before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = np.empty(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            rows = _matrix(batch.column(1)) if rows is None else np.concatenate([rows, _matrix(batch.column(1))])
            while len(ids) >= 2 * BLOCK:
                yield _best(ids[:BLOCK], ids[:BLOCK], rows[:BLOCK] @ rows[:BLOCK].T, k)
                ids, rows = ids[BLOCK // 2 :], rows[BLOCK // 2 :]
        if len(ids) > 1:
            yield _best(ids, ids, rows @ rows.T, k)

    return run


def _local(k: int):
    """Among the nodes of each row (ids, vectors, least) each one's k nearest, if they aren't less similar than the last that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # The lists' own arrays, without an object for each entry.
            near, vectors = batch.column(0), batch.column(1)
            size = pc.list_value_length(near).to_numpy()
            ends = np.cumsum(size)
            ids, rows, least = near.flatten().to_numpy(), vectors.flatten(), batch.column(2).flatten().to_numpy()
            rows = rows.flatten().to_numpy().reshape(len(ids), -1)
            found = []
            for end, n in zip(ends[size > 1], size[size > 1], strict=True):
                own, some = ids[end - n : end], rows[end - n : end]
                found.append(_best(own, own, some @ some.T, k, least[end - n : end]))
            if found:
                yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]

    return run


def _top(edges: DataFrame, k: int, by: str = "id", other: str = "near") -> DataFrame:
    """Each node's k most similar, ties by node. What a task has too many of goes before the shuffle."""
    r = F.row_number().over(W.partitionBy(by).orderBy(F.desc("similarity"), other))
    return edges.withColumn("r", r).where(F.col("r") <= k).drop("r")


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(id, vector) of length one; rows without id or vector and zero vectors are left out."""
    rows = vectors.where("id IS NOT NULL AND vector IS NOT NULL").select("id", normalize(F.col("vector")).alias("vector"))
    return rows.where(F.exists("vector", lambda x: x != 0))


def graph(vectors: DataFrame, at: str, k: int = K, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """(id, near, similarity): about the k nearest by cosine of each vector (id, vector); none is its own. The rows are read from the folder at.

    Vectors of a length other than the most frequent one, null and zero ones are left out. Ids are distinct whole numbers. A node names the WIDE nearest
    (or k, if more) that it has met so far; a round compares what it names and as many, by hash, of those that name it, however many do. Rounds
    end when less than STILL of the edges change. Equal vectors are near each other like any others.
    """
    spark, wanted, k = ship(vectors.sparkSession), k, max(k, WIDE)
    unit = written(unit_vectors(vectors), f"{at}/unit")
    dims = unit.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], EDGE)
    unit, dims = unit.where(F.size("vector") == dims[0]["d"]), dims[0]["d"]
    rng = np.random.default_rng(seed)
    first = None
    for _ in range(ORDERS):
        ray = F.array(*(F.lit(float(x)) for x in rng.standard_normal(dims)))
        along = F.aggregate(F.zip_with("vector", ray, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        line = unit.withColumn("along", along).repartitionByRange("along", "id").sortWithinPartitions("along", "id")
        part = line.select("id", "vector").mapInArrow(_blocks(k), EDGE)
        first = part if first is None else first.unionAll(part)
    edges = written(_top(first.distinct(), k), f"{at}/0")
    for n in range(1, rounds + 1):
        named = edges.select("id", "near")
        naming = named.select(F.col("near").alias("id"), F.col("id").alias("near"))
        r = F.row_number().over(W.partitionBy("id").orderBy(F.xxhash64("near", F.lit(n)), "near"))
        about = named.unionAll(naming.withColumn("r", r).where(F.col("r") <= k).drop("r")).unionAll(unit.select("id", F.col("id").alias("near"))).distinct()
        # What a node's k edges all surpass can't change them and is not put out.
        last = edges.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("least"))
        known = unit.join(last, "id", "left").select(F.col("id").alias("near"), "vector", F.coalesce("least", F.lit(-2.0)).alias("least"))
        members = about.join(known, "near").groupBy("id").agg(F.collect_list(F.struct(F.col("near").alias("id"), "vector", "least")).alias("members"))
        found = members.select("members.id", "members.vector", "members.least").mapInArrow(_local(k), EDGE)
        after = written(_top(edges.unionAll(found).distinct(), k), f"{at}/{n}")
        changed, whole = after.join(edges, ["id", "near"], "left_anti").count(), after.count()
        delete(spark, f"{at}/{n - 1}")
        edges = after
        if changed <= STILL * whole:
            break
    delete(spark, f"{at}/unit")
    return _top(edges, wanted)


def build(vectors: DataFrame, path: str, k: int = K, seed: int = 7) -> None:
    """Store an index of vectors (id, vector) below path: unit vectors, and edges in both directions of every layer.

    A node is in layers 0 up to a level that a hash of its id decides, one in THINNER in each next one, until a layer has TOP nodes or fewer.
    """
    spark = vectors.sparkSession
    rows = unit_vectors(vectors)
    chance = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) + 1) / F.lit(float(1 << 53))
    rows = rows.withColumn("level", F.floor(-F.log(chance) / float(np.log(THINNER))).cast("int"))
    rows = written(rows.repartition("id").sortWithinPartitions("id"), f"{path}/vectors")
    delete(spark, f"{path}/edges")
    layer, held = 0, rows
    while layer == 0 or held.count() > TOP:
        with scratch(spark, "layer") as at:
            near = graph(held.select("id", "vector"), at, k, seed=seed + layer)
            ways = near.select("id", "near").unionAll(_top(near.select(F.col("near").alias("id"), F.col("id").alias("near"), "similarity"), 2 * k).select("id", "near")).distinct()
            listed = ways.groupBy("id").agg(F.sort_array(F.collect_list("near")).alias("near"))
            listed.withColumn("layer", F.lit(layer)).repartition("id").sortWithinPartitions("id").write.mode("append").parquet(f"{path}/edges")
        layer += 1
        held = rows.where(F.col("level") >= layer)
    spark.createDataFrame([(layer,)], "top int").coalesce(1).write.mode("overwrite").parquet(f"{path}/top")


def _similarity(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(spark: SparkSession, path: str, queries: DataFrame, at: str, k: int = 10, ef: int = EF) -> DataFrame:
    """(query_id, id, similarity, rank, compared): about the k nearest of each query (query_id, query) in the index at path, ties by id, and how
    many vectors the query was compared with. A query that is itself indexed finds its own vector first. The rows are read from the folder at.

    Layers above the lowest are descended with a beam of one, the lowest with ef; a round expands up to EXPANDED nodes of each query's beam that
    weren't yet in that layer, until no beam has any. Null and zero queries find nothing.
    """
    vectors, edges = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/edges")
    top = spark.read.parquet(f"{path}/top").first()["top"]
    asked = written(unit_vectors(queries.toDF("id", "vector")).toDF("query_id", "query"), f"{at}/asked")
    # Every query meets the few nodes of the top, or of the highest levels if none reaches it.
    highest = vectors.orderBy(F.desc("level"), "id").limit(TOP).select("id", "vector")
    score = _similarity("query", "vector").alias("similarity")
    met, n = written(asked.crossJoin(F.broadcast(highest)).select("query_id", "id", score, F.lit(top).alias("layer")), f"{at}/0"), 0
    for layer in range(top - 1, -1, -1):
        near = edges.where(F.col("layer") == layer).select("id", "near")
        while True:
            # layer: the lowest one in which a query has expanded the node.
            best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
            ahead = met.withColumn("r", best).where((F.col("r") <= (1 if layer else ef)) & (F.col("layer") > layer))
            turn = F.row_number().over(W.partitionBy("query_id").orderBy("r"))
            ahead = written(ahead.withColumn("turn", turn).where(F.col("turn") <= EXPANDED).select("query_id", "id"), f"{at}/ahead-{n}")
            if ahead.isEmpty():
                break
            fresh = ahead.join(near, "id").select("query_id", F.explode("near").alias("id")).distinct().join(met.select("query_id", "id"), ["query_id", "id"], "left_anti")
            fresh = fresh.join(vectors.select("id", "vector"), "id").join(asked, "query_id").select("query_id", "id", score, F.lit(top).alias("layer"))
            now = met.join(ahead.withColumn("now", F.lit(layer)), ["query_id", "id"], "left").select("query_id", "id", "similarity", F.coalesce("now", "layer").alias("layer"))
            n += 1
            met = written(now.unionAll(fresh), f"{at}/{n}")
            delete(spark, f"{at}/{n - 1}")
            delete(spark, f"{at}/ahead-{n - 1}")
    own = W.partitionBy("query_id")
    found = met.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.count(F.lit(1)).over(own).alias("compared"))
    first = F.row_number().over(own.orderBy(F.desc("similarity"), F.col("id") != F.col("query_id"), "id"))
    return found.withColumn("rank", first.cast("bigint")).where(F.col("rank") <= k).select("query_id", "id", "similarity", "rank", "compared")
