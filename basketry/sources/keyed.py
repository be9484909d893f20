"""A table kept by key: rows lie in buckets by the hash of some of their columns, and a manifest names the folder that holds each bucket now.

A change reads the buckets that its rows fall into, merges them, writes those anew and then publishes the next manifest, which is
one file that must not be there yet. So a reader sees a whole state, a failed change leaves only files that no manifest names, a change that is repeated under
its batch name does nothing, and buckets without a change keep their files. Point reads open the folders of their keys' buckets alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import scratch, written

#: Buckets of a new table, and parts that a bucket is written in side by side, so that one of very many rows fills no single task.
BUCKETS, PARTS = 16, 4


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The latest state of the table at path: version, keys, buckets, folders by bucket, batches; None if there is none."""
    fs, where = _hadoop(spark, f"{path}/manifests")
    if not fs.exists(where):
        return None
    names = sorted(f.getPath().getName() for f in fs.listStatus(where) if f.getPath().getName().endswith(".json"))
    return json.loads(spark.read.text(f"{path}/manifests/{names[-1]}", wholetext=True).first()["value"]) if names else None


def _publish(spark: SparkSession, path: str, state: dict) -> None:
    """Put the next manifest in place; fails if another writer has published that version meanwhile."""
    name = f"{path}/manifests/{state['version']:08d}.json"
    fs, draft = _hadoop(spark, f"{name}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if fs.exists(_hadoop(spark, name)[1]) or not fs.rename(draft, _hadoop(spark, name)[1]):
        raise RuntimeError(f"version {state['version']} of {path} was published by another writer")


def _bucket(by: list[str], buckets: int):
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def _open(spark: SparkSession, path: str, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
    folders = [f for b, f in sorted(state["folders"].items()) if buckets is None or int(b) in buckets]
    return spark.read.option("basePath", f"{path}/data").parquet(*(f"{path}/data/{f}" for f in folders)).drop("version") if folders else None


def latest(order: list[str]) -> Callable[[DataFrame, list[str]], DataFrame]:
    """Merge by taking the new row of a key in place of the old one; of new rows with one key the last by order, nulls first."""

    def merge(rows: DataFrame, keys: list[str]) -> DataFrame:
        r = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_new"), *(F.desc(c) for c in order)))
        return rows.withColumn("_r", r).where("_r = 1").drop("_r", "_new")

    return merge


def summed(column: str) -> Callable[[DataFrame, list[str]], DataFrame]:
    """Merge by adding up a column."""
    return lambda rows, keys: rows.groupBy(*keys, "bucket").agg(F.sum(column).alias(column))


def change(rows: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame, list[str]], DataFrame], batch: str, by: list[str] | None = None, buckets: int = BUCKETS) -> dict:
    """Merge rows into the table at path and return its new state. Keys that hold a null are left out.

    by: the columns whose hash is the bucket, all keys if none are named. A batch that the table has had is passed over. An existing
    table keeps its number of buckets; its columns must be those of rows.
    """
    spark = rows.sparkSession
    state = manifest(spark, path) or {"version": 0, "keys": keys, "by": by or keys, "buckets": buckets, "folders": {}, "batches": []}
    if batch in state["batches"]:
        return state
    fresh = rows.dropna(subset=keys).withColumn("bucket", _bucket(state["by"], state["buckets"])).withColumn("_new", F.lit(True))
    with scratch(spark, "change") as at:
        # Held, as both the buckets that it touches and the merge ask for it.
        fresh = written(fresh, f"{at}/fresh")
        touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())
        old = _open(spark, path, state, touched)
        merged = merge(fresh if old is None else fresh.unionByName(old.withColumn("_new", F.lit(False))), keys)
        version = state["version"] + 1
        part = F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(PARTS))
        out = merged.repartition("bucket", part).sortWithinPartitions("bucket", *keys)
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    folders = state["folders"] | {str(b): f"version={version}/bucket={b}" for b in touched}
    state = state | {"version": version, "folders": folders, "batches": [*state["batches"], batch]}
    _publish(spark, path, state)
    return state


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table at path."""
    return _open(spark, path, manifest(spark, path)).drop("bucket")


def lookup(spark: SparkSession, path: str, values: list[tuple]) -> DataFrame:
    """The rows whose bucket columns have one of the given values; only their buckets' folders are opened, and the values are pushed into the scan."""
    state = manifest(spark, path)
    by = state["by"]
    kinds = {f.name: f.dataType for f in _open(spark, path, state).schema}
    asked = spark.createDataFrame(values, ", ".join(f"{c} {kinds[c].simpleString()}" for c in by))
    wanted = {r["bucket"] for r in asked.select(_bucket(by, state["buckets"]).alias("bucket")).distinct().collect()}
    rows = _open(spark, path, state, sorted(wanted))
    if rows is None:
        return _open(spark, path, state).limit(0).drop("bucket")
    for i, c in enumerate(by):
        rows = rows.where(F.col(c).isin([v[i] for v in values]))
    return (rows if len(by) == 1 else rows.join(F.broadcast(asked), by, "left_semi")).drop("bucket")
