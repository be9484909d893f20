"""Queries that write a table in a source's format and read it back through the reader.

The files lie in the shared checkpoint folder under the application's id, and a later run of the same query writes over them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..session import checkpoint_dir, delete
from ..sources import keyed, readers, writers
from . import graphs
from . import tables as t
from .tables import edges_sql


def _at(s, name: str) -> str:
    return f"{checkpoint_dir(s)}/round-trip-{s.sparkContext.applicationId}/{name}"


def _parts(s, d):
    return t.table(s, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"), "p_retailprice")


def _dump(s, d):
    path = _at(s, "dump")
    writers.dump(_parts(s, d), path)
    return readers.dump(s, path, "p_partkey bigint, p_name string, p_size int, p_retailprice double", ["p_partkey", "p_name", "p_size"])


def _lines(s, d):
    """Every third line has a field too many, every fifth one that is no number."""
    path, k = _at(s, "lines"), F.col("p_partkey")
    price = F.when(k % 5 == 0, "none").otherwise(F.col("p_size").cast("string"))
    line = F.concat_ws("\t", k, "p_name", price, F.when(k % 3 == 0, "more"))
    t.table(s, d, "part").select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
    return readers.guarded_lines(s, path, "p_partkey bigint, p_name string, p_size int")


def _slices(s, d):
    """A slice is a file of the baskets whose ids have the same thousands."""
    rows = t.rows(s, d).select("pid", F.struct((F.col("pos") - 1).cast("int").alias("pos"), F.concat(F.lit("track:"), "item").alias("track_uri"), F.col("title").alias("track_name"), F.col("owner").alias("artist_name")).alias("t"))
    lists = rows.groupBy("pid").agg(F.sort_array(F.collect_list("t")).alias("tracks")).withColumn("collaborative", F.when(F.col("pid") % 2 == 0, "true").otherwise("false"))
    slices = lists.groupBy(F.floor(F.col("pid") / 1000).alias("slice")).agg(F.collect_list(F.struct("pid", "collaborative", "tracks")).alias("playlists"))
    path = _at(s, "slices")
    slices.select("playlists").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)
    return readers.playlist_slices(s, path)


def _slice_lists(s, d):
    lists, _, places = _slices(s, d)
    return lists.select("pid", "collaborative").join(places.groupBy("pid").agg(F.count(F.lit(1)).alias("tracks")), "pid")


def _slice_tracks(s, d):
    return _slices(s, d)[1].select("track_uri", "track_name", "artist_name")


def _lookup(s, d):
    path = _at(s, "lookup")
    writers.lookup(t.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), path, ["o_custkey", "o_orderkey"])
    return readers.columns(s, path, ["o_custkey", "o_orderkey"]).where("o_custkey BETWEEN 10 AND 14")


def _columns(s, d):
    path = _at(s, "columns")
    writers.parquet(t.table(s, d, "part"), path)
    return readers.columns(s, path, ["p_partkey", "p_brand"])


def _edge_table(s, d) -> str:
    """The edge table of all baskets, added in two batches, the second one twice."""
    path = _at(s, "edges")
    delete(s, path)
    rows = t.basket_items(s, d)
    for batch, some in (("even", "pid % 2 = 0"), ("odd", "pid % 2 = 1"), ("odd", "pid % 2 = 1")):
        graph.keep_edges(rows.where(some), "pid", "node", path, batch)
    return path


def _upsert(s, d):
    """All parts, then those of a size over 40 again at another price, twice."""
    path = _at(s, "upsert")
    delete(s, path)
    rows = t.table(s, d, "part").select("p_partkey", "p_name", "p_retailprice")
    dearer = t.table(s, d, "part").where("p_size > 40").select("p_partkey", "p_name", (F.col("p_retailprice") + 1000).alias("p_retailprice"))
    for batch, some in (("all", rows), ("dearer", dearer), ("dearer", dearer)):
        keyed.change(some, path, ["p_partkey"], keyed.latest(["p_retailprice"]), batch)
    return keyed.read(s, path)


QUERIES = {
    "edge_table": lambda s, d: keyed.read(s, _edge_table(s, d)),
    "edge_table_compass": lambda s, d: graph.compass(graph.kept_edges(s, _edge_table(s, d), [1]), 1),
    "edge_table_blend": lambda s, d: graph.blend(graph.kept_edges(s, _edge_table(s, d), [1, 2, 3]), [1, 2, 3]),
    "keyed_upsert": _upsert,
    "dump_round_trip": _dump,
    "guarded_lines_round_trip": _lines,
    "slices_lists": _slice_lists,
    "slices_tracks": _slice_tracks,
    "sorted_lookup": _lookup,
    "columns_round_trip": _columns,
}

ORACLE = {
    "edge_table": f"WITH {edges_sql()} SELECT src, dst, weight FROM both_ways",
    "edge_table_compass": graphs.ORACLE["compass_neighbors"],
    "edge_table_blend": graphs.ORACLE["group_blend"],
    "keyed_upsert": "SELECT p_partkey, p_name, CASE WHEN p_size > 40 THEN p_retailprice + 1000 ELSE p_retailprice END AS p_retailprice FROM part",
    "dump_round_trip": "SELECT p_partkey, p_name, CASE WHEN p_size > 10 THEN p_size END AS p_size FROM part",
    "guarded_lines_round_trip": "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0",
    "slices_lists": "SELECT CAST(l_orderkey AS INT) AS pid, l_orderkey % 2 = 0 AS collaborative, count(*) AS tracks FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey",
    "slices_tracks": "SELECT DISTINCT 'track:' || p_partkey AS track_uri, p_name AS track_name, p_brand AS artist_name FROM lineitem JOIN part ON l_partkey = p_partkey",
    "sorted_lookup": "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 14",
    "columns_round_trip": "SELECT p_partkey, p_brand FROM part",
}
