"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship

#: Rows and bytes in one Arrow batch; the second keeps a batch of very long texts small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Ship the package, set bounded Arrow batches and see to the checkpoint folder."""
    ship(spark)
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder and go on from there.

    What checkpoint() returns keeps the estimates of the plan behind it. A join's size is the product of its sides', so that from one
    checkpoint to the next estimates would double in digits and planning stall; so the rows go on without them.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def partitions(spark: SparkSession) -> int:
    """The cluster's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """A computed df, marked to be broadcast if it has at most so many rows; beyond that it is joined like any other."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def raw_text(col: str = "text") -> F.Column:
    """The UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def packed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, mark): each row as one column, so that none of its names meets an operator's own; mark tells rows that repeat doc_id and text apart."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*cols).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(*cols).alias("mark"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that packed() made one column of."""
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in columns))


def word_ids(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The words of all texts in a row, as places in a list of the different ones, that list, and where each text's words begin (one more for the end)."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    if "" in words:  # white space at either end of a text leaves an empty word
        full = at != words.index("")
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        at = at[full]
    return at.astype(np.int64), words, offsets


_KEPT: dict[str, object] = {}


def of_worker(name: str, make: Callable[[], object]) -> object:
    """What make makes, kept for the later tasks of this Python worker until a task asks for another name."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def let_go() -> None:
    """Drop what this Python worker keeps."""
    _KEPT.clear()


def over_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], keeps: bool = False) -> DataFrame:
    """mapInArrow with a function that is made once per task; batches that it answers with None vanish.

    Unless it keeps something of_worker, what others kept in the worker is let go first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            let_go()
        each = make()
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
