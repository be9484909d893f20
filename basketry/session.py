"""Session helpers: making the package importable on executors, and the cluster's checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return spark
    _SHIPPED.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="basketry-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    atexit.register(lambda: os.path.exists(path) and os.remove(path))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where it is unset and the master is local (tests, one machine) a local one is made."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="basketry-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the cluster's file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, path: str, options: dict[str, str] | None = None) -> DataFrame:
    """df as Parquet at path, read back: rows that a lost executor doesn't take away, without the plan behind them."""
    df.write.mode("overwrite").options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that a task should meet at most where it joins or counts them by key.
TASK_ROWS = 400_000


def tasks(*tables: DataFrame) -> int:
    """Among how many tasks to deal out tables, by their rows together, so that a task's share stays the same however large they are."""
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-sum(df.count() for df in tables) // TASK_ROWS))


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder in the shared checkpoint folder that is gone when the block ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete(spark, path)
