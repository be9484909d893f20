"""Hard-negative mining by bit-sliced integer products.

A component is an integer, and a row's components are taken apart into bit-planes, the sign plane first:
x = -2^B * s + 2^(B-1) * p(B-1) + ... + p(0). A score is built plane by plane, the most significant first. With b planes to
come an anchor a can gain at most (2^b - 1) times the sum of its positive components and lose at most as much of its negative ones, so
every pair has an interval that its score lies in, which each plane halves. A pair is dropped once its interval cannot qualify: for
positives when its upper end is below the k-th highest lower end met so far, for negatives when it meets none of the anchor's ranges of
wanted scores above the third best found there. Planes are multiplied for all pairs of a tile while many are left and pair by pair after.

Anchors are broadcast in blocks of bounded bytes; each block is two scans of all rows. A task keeps a fixed number of rows for each
anchor, so no label, however common, gathers anywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import let_go, ready, table

#: Bytes of anchors that are broadcast at a time, anchors of a tile, and the share of a tile's pairs below which they are followed singly.
BLOCK_BYTES, TILE, FEW = 32 << 20, 1024, 1 / 16
#: The farthest that a score may lie from zero: 95 times it is still a long.
FAR = 1 << 56
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def finite(vector: str) -> F.Column:
    """Whether a vector is there and all of its entries are finite numbers."""
    ok = F.forall(F.col(vector), lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def exact_type(dims: int, most: int) -> type:
    """The fastest kind of number in which sums of dims products of integers up to most are exact."""
    far = dims * most * most
    return np.float32 if far < 1 << 24 else np.float64 if far < 1 << 53 else np.int64


def matrix(lists: pa.Array, dims: int, most: int) -> np.ndarray:
    """The integers of list values as rows of a matrix; what a shorter list lacks is 0, what lies beyond most is most."""
    ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    size = np.diff(ends)
    out = np.zeros((len(lists), dims), np.int64)
    if ends[-1]:
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(ends[-1]) - ends[:-1][row]] = lists.flatten().to_numpy()
    return np.clip(out, -most, most)


def planes(x: np.ndarray, bits: int, kind: type) -> Iterator[tuple[int, int, np.ndarray]]:
    """(planes to come, weight, plane) of a matrix of integers from -2^bits up to 2^bits - 1, the most significant first."""
    yield bits, -(1 << bits), (x < 0).astype(kind)
    for b in range(bits - 1, -1, -1):
        yield b, 1 << b, (x >> b & 1).astype(kind)


def scored(a: np.ndarray, x: np.ndarray, bits: int, low: np.ndarray, high: np.ndarray | None = None, best: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs whose score can lie from low up to high, and of those left out none does.

    low, high: for each anchor. best: only an anchor's so many highest scores are wanted (ties stay), so low rises as intervals tighten.
    """
    kind = a.dtype.type
    up, down = np.maximum(a, 0).sum(axis=1), np.minimum(a, 0).sum(axis=1)
    score = np.zeros((len(a), len(x)), kind)
    row = col = None
    for to_come, weight, plane in planes(x, bits, kind):
        rest = kind((1 << to_come) - 1)
        if row is None:
            score += kind(weight) * (a @ plane.T)
            if best and score.shape[1] >= best:
                low = np.maximum(low, np.partition(score, -best, axis=1)[:, -best] + rest * down)
            alive = score >= (low - rest * up)[:, None]
            if high is not None:
                alive &= score <= (high - rest * down)[:, None]
            if np.count_nonzero(alive) <= FEW * alive.size or not to_come:
                row, col = np.nonzero(alive)
                score = score[row, col]
        elif len(row):
            score = score + kind(weight) * np.einsum("ij,ij->i", a[row], plane[col])
            alive = score >= low[row] - rest * up[row]
            if high is not None:
                alive &= score <= high[row] - rest * down[row]
            row, col, score = row[alive], col[alive], score[alive]
    return row, col, score.astype(np.int64)


class Best:
    """The k best (score, id) of each group met so far, higher scores first, ties by smaller id."""

    def __init__(self, groups: int, k: int):
        self.k, self.group, self.score, self.id = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.low = np.full(groups, -np.inf)  # what a group's next one has to reach

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        first = np.nonzero(np.diff(group, prepend=-1))[0]
        place = np.arange(len(group)) - np.repeat(first, np.diff([*first, len(group)]))
        full = place == self.k - 1
        self.low[group[full]] = score[full]
        kept = place < self.k
        self.group, self.score, self.id = group[kept], score[kept], ids[kept]


def _positives(block: dict, k: int, bits: int):
    """A task's k best rows of an anchor's own label, for each anchor of the block."""
    a, labels = block["x"], block["label"]
    of = {v: np.nonzero(labels == v)[0] for v in np.unique(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        found = Best(len(a), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = matrix(batch.column(2), a.shape[1], block["most"])
            for label in np.unique(own):
                here = np.nonzero(own == label)[0]
                mine = of.get(label, ())
                for lo in range(0, len(mine), TILE):
                    at = mine[lo : lo + TILE]
                    row, col, score = scored(a[at], x[here], bits, found.low[at].astype(a.dtype if a.dtype != np.int64 else float), best=k)
                    if len(row):
                        found.add(at[row], score, ids[here[col]])
        yield pa.RecordBatch.from_arrays([pa.array(found.group), pa.array(found.score), pa.array(found.id)], ["a", "score", "id"])

    return run


def _negatives(block: dict, k: int, bits: int):
    """A task's k best rows of other labels within each of an anchor's ranges of scores."""
    a, labels, lows, highs = block["x"], block["label"], block["low"], block["high"]
    ranges = lows.shape[1]
    kind = a.dtype if a.dtype != np.int64 else np.dtype(float)
    order = np.argsort(labels, kind="stable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        found = Best(len(a) * ranges, k)
        top = highs.max(axis=1, initial=-np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = matrix(batch.column(2), a.shape[1], block["most"])
            for lo in range(0, len(order), TILE):
                at = order[lo : lo + TILE]
                low = np.maximum(lows[at], found.low.reshape(-1, ranges)[at])
                asked = low.min(axis=1, initial=np.inf)
                at, low, asked = at[np.isfinite(asked)], low[np.isfinite(asked)], asked[np.isfinite(asked)]
                if not len(at):
                    continue
                row, col, score = scored(a[at], x, bits, asked.astype(kind), top[at].astype(kind))
                other = labels[at[row]] != own[col]
                row, col, score = row[other], col[other], score[other]
                pair, r = np.nonzero((score[:, None] >= low[row]) & (score[:, None] <= highs[at[row]]))
                if len(pair):
                    found.add(at[row[pair]] * ranges + r, score[pair], ids[col[pair]])
        of, r = found.group // ranges, found.group % ranges
        columns = [of, block["id"][of], block["times"][of], r, block["positive_id"][of, r], block["positive_score"][of, r], found.id, found.score]
        names = ["a", "anchor_id", "times", "r", "positive_id", "positive_score", "negative_id", "negative_score"]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    return run


def _first(df: DataFrame, k: int, by: list[str], score: str, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), name)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: F.Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first positives rows of the
    same label, the first negatives rows of other labels whose score is from low up to high per cent of the positive's.

    vectors: (vec_id, label, vector), both first ones whole numbers; other columns are passed over. anchor: a condition on vec_id, label and vector.
    A component c is floor(scale * c); what a vector lacks against the longest is 0. Higher scores come first, ties by smaller vec_id. A row
    without vec_id, label or vector, or with an entry that is null or not finite, takes no part. A row that is repeated counts as often as it is
    there, among anchors too, and is no positive of itself but of its copies. A positive of negative score has no negatives (its range is empty). An
    empty table gives no rows. Components beyond the root of 2^56 / dimensions, where a score might leave the longs, count as that.
    """
    spark = ready(vectors.sparkSession)
    ints = F.transform("vector", lambda c: F.floor(c.cast("double") * scale))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("vector"))
    rows = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), ints.alias("x"))
    asked = usable.where(anchor).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), ints.alias("x"))
    most = F.array_max(F.transform("x", lambda v: F.greatest(v, -v)))
    told = rows.agg(F.max(F.size("x")).alias("dims"), F.max(most).alias("most")).first()
    dims = told["dims"] or 1
    most = max(1, min(told["most"] or 0, int((FAR // dims) ** 0.5)))
    bits, kind = most.bit_length(), exact_type(dims, most)
    anchors = asked.groupBy("vec_id", "label", "x").agg(F.count(F.lit(1)).alias("times"))
    blocks = max(1, -(-asked.count() * (dims + 2 * positives + 4) * 8 // block_bytes))
    at = f"{checkpoint_dir(spark)}/negatives-{uuid.uuid4().hex}"
    for i in range(blocks):
        part = anchors.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        columns = {c: part[c].chunk(0) for c in part.column_names}
        block = {"id": columns["vec_id"].to_numpy(), "label": columns["label"].to_numpy(), "times": columns["times"].to_numpy(), "most": most}
        block["x"] = matrix(columns["x"], dims, most).astype(kind)
        shared = spark.sparkContext.broadcast(block)
        own = rows.mapInArrow(lambda batches, shared=shared: _positives(shared.value, positives + 1, bits)(batches), "a long, score long, id long")
        own = _first(own, positives + 1, ["a"], "score", "id").select("a", "rank", "score", "id").toArrow().to_pydict()
        order = np.lexsort((own["rank"], own["a"]))
        of, score, ids = (np.array(own[c], np.int64)[order] for c in ("a", "score", "id"))
        # Of the rows that are the anchor itself one goes; an anchor that is not among the first has none there.
        full = block["x"].astype(object) if dims * most * most >= 1 << 53 else block["x"].astype(float)
        itself = (ids == block["id"][of]) & (score == (full * full).sum(axis=1)[of].astype(np.int64))
        _, first = np.unique(np.where(itself, of, -1), return_index=True)
        gone = np.zeros(len(of), bool)
        gone[first[itself[first]]] = True
        of, score, ids = of[~gone], score[~gone], ids[~gone]
        starts = np.nonzero(np.diff(of, prepend=-1))[0]
        place = np.arange(len(of)) - np.repeat(starts, np.diff([*starts, len(of)]))
        of, score, ids, place = (v[place < positives] for v in (of, score, ids, place))
        shape = (len(block["id"]), positives)
        block |= {"positive_id": np.zeros(shape, np.int64), "positive_score": np.zeros(shape, np.int64), "low": np.full(shape, np.inf), "high": np.full(shape, -np.inf)}
        block["positive_id"][of, place], block["positive_score"][of, place] = ids, score
        block["low"][of, place], block["high"][of, place] = -(-low * score // 100), high * score // 100
        shared.destroy()
        shared = spark.sparkContext.broadcast(block)
        schema = "a long, anchor_id long, times long, r long, positive_id long, positive_score long, negative_id long, negative_score long"
        found = rows.mapInArrow(lambda batches, shared=shared: _negatives(shared.value, negatives, bits)(batches), schema)
        found = _first(found, negatives, ["a", "r"], "negative_score", "negative_id")
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
        found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(at)
        shared.destroy()
    return spark.read.schema(RESULT).parquet(at) if blocks and _there(spark, at) else spark.createDataFrame([], RESULT)


def _there(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def op13_hard_negatives(spark, sf_dir):
    """Three hard negatives at most for each of five positives at most of every anchor, a row whose vec_id is divisible by 50; a label goes up by one
    (of ten) where vec_id is divisible by 7. Nulls, repeated rows, ties and empty tables as in hard_negatives."""
    rows = table(ready(spark), sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), F.col("embedding").alias("vector")), F.col("vec_id") % 50 == 0)


#: The same rows by definition.
OP13_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding] AS x
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum([a.x[i] * b.x[i] for i in range(1, len(a.x) + 1)]) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
