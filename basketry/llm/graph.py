"""Connected components by minimum labels and pointer jumping; nothing is gathered on the driver but counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that a task thins out at a time.
SHARE = 100_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of a task's edges (u, v), SHARE at a time, that connects what they connect."""

    def thinned(edges: np.ndarray) -> pa.RecordBatch:
        nodes, ends = np.unique(edges, return_inverse=True)
        root = list(range(len(nodes)))
        kept = []
        for i, (a, b) in enumerate(ends.reshape(edges.shape).tolist()):
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append(i)
        return pa.RecordBatch.from_arrays([pa.array(edges[kept, 0]), pa.array(edges[kept, 1])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
        n += batch.num_rows
        if n >= SHARE:
            yield thinned(np.concatenate(held))
            held, n = [], 0
    if n:
        yield thinned(np.concatenate(held))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all of a task's edges (u, v), which are at most SHARE."""
    held = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1) for batch in batches]
    if not held:
        return
    edges = np.concatenate(held)
    nodes, ends = np.unique(edges, return_inverse=True)
    root = list(range(len(nodes)))
    for a, b in ends.reshape(edges.shape).tolist():
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        root[max(a, b)] = min(a, b)
    for i, at in enumerate(root):  # smaller nodes come first, and theirs are final by then
        root[i] = root[at]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that has an edge, with the smallest node it can reach.

    Loops and repeated edges are allowed. A node with very many edges is no bottleneck: labels are
    joined to edges by a sort-merge join that can split, and minima are combined before they are shuffled.
    Edges are thinned out to forests first, in shares of a bounded size, so that a dense group keeps few of
    its many; edges that are no more than one share are labelled there at once. Each round halves the pointer chains, and its
    result is cut with a checkpoint.
    """
    pairs = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct())
    tasks = -(-pairs.count() // SHARE)
    if tasks <= 1:
        return cut(pairs.coalesce(1).mapInArrow(_labelled, "node long, root long"))
    # Which forest it is depends on the order in which edges arrive, so it is kept before both directions are taken from it.
    pairs = cut(pairs.repartition(tasks).mapInArrow(_forest, "u long, v long"))
    both = cut(pairs.union(pairs.select("v", "u")).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        heard = (
            both.join(labels.select(F.col("node").alias("v"), "root"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("root").alias("heard"))
        )
        lower = labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        lower = cut(lower)
        ends = lower.select(F.col("node").alias("root"), F.col("root").alias("end"))
        after = cut(lower.join(ends, "root", "left").select("node", "old", F.least("root", F.coalesce("end", "root")).alias("root")))
        labels = after.select("node", "root")
        if after.where("root <> old").isEmpty():
            return labels
