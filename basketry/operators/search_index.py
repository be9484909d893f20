"""A stored inverted index: postings in blocks by token, a sorted table of tokens, lengths of texts.

Each task counts the words of a batch of texts by array operations and puts out a list of texts for each word and stretch, so that what is shuffled are
lists and no single postings. Lists that meet are joined as they stream by in order of token and stretch. A block holds a token's texts whose ids lie in one stretch of SPAN ids, as gaps from one to the next, so however common a token is, no block and no
group has more than SPAN. Blocks lie in folders by the hash of their token; a search opens the folders of its tokens and pushes the tokens into the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import ship, written

#: Ids of a block's stretch and folders of blocks.
SPAN, BUCKETS = 1 << 14, 32


def _bucket(token: str) -> F.Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


#: Bytes that are part of a word, in lower-cased text.
_WORD = np.zeros(256, bool)
_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows begin that are alike in all columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.nonzero(new)[0]


def _lists(values: np.ndarray, begins: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(begins, len(values)), pa.int32()), pa.array(values, kind))


def _listed(span: int):
    """For mapInArrow over (id, b), b the bytes of a lower-cased text: (token, stretch, ids, times) of a batch; token null: how many words each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            line = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            # A byte between texts, so that no word goes on into the next.
            stop = offsets[1:] - offsets[0] + np.arange(len(texts))
            inner = np.ones(len(line) + len(texts), bool)
            inner[stop] = False
            word = np.zeros(len(inner), bool)
            word[inner] = _WORD[line]
            begin, end = (np.nonzero(x)[0] for x in (word & ~np.append(False, word[:-1]), word & ~np.append(word[1:], False)))
            if not len(begin):
                continue
            places = np.append(0, np.cumsum(end - begin + 1))
            words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(places), pa.py_buffer(line[word[inner]].tobytes())]).dictionary_encode()
            ids, of = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            keys, times = np.unique(words.indices.to_numpy().astype(np.int64) * len(ids) + of[np.searchsorted(stop, begin)], return_counts=True)
            token, text = keys // len(ids), keys % len(ids)
            stretch = ids[text] // span
            at = _edges(token, stretch)
            yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()).take(pa.array(token[at])), pa.array(stretch[at]), _lists(ids[text], at, pa.int64()), _lists(times, at, pa.int64())], _LISTED)
            size = np.bincount(text, times, len(ids)).astype(np.int64)
            ids, size = ids[size > 0], size[size > 0]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), _lists(ids, np.zeros(1, int), pa.int64()), _lists(size, np.zeros(1, int), pa.int64())], _LISTED)

    return run


_LISTED = ["token", "stretch", "ids", "times"]


def _joined(span: int):
    """For mapInArrow over (bucket, token, stretch, ids, times) sorted by these three: blocks, the lists of a token and stretch as one. Gaps are from one id to
    the next, the first from the stretch's beginning. An id of several lists comes once."""

    def blocks(rows: pa.Table) -> pa.RecordBatch:
        token, stretch, bucket = rows["token"].combine_chunks(), rows["stretch"].to_numpy(), rows["bucket"].combine_chunks()
        code = token.dictionary_encode().indices.to_numpy()
        first = _edges(code, stretch)
        group = np.repeat(np.arange(len(first)), np.diff(first, append=len(code)))
        ids, times = (rows[c].combine_chunks() for c in ("ids", "times"))
        owner = np.repeat(group, np.diff(ids.offsets.to_numpy()))
        ids, times = ids.flatten().to_numpy(), times.flatten().to_numpy()
        order = np.lexsort((ids, owner))
        ids, times, owner = ids[order], times[order], owner[order]
        once = _edges(owner, ids)
        times, ids, owner = np.add.reduceat(times, once), ids[once], owner[once]
        at = _edges(owner)
        gaps = np.diff(ids, prepend=0)
        gaps[at] = ids[at] - stretch[first] * span
        return pa.RecordBatch.from_arrays([token.take(pa.array(first)), pa.array(stretch[first]), _lists(gaps, at, pa.int32()), _lists(times, at, pa.int32()), bucket.take(pa.array(first))], _BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last token and stretch may go on in the next batch.
            rows = pa.Table.from_batches([*held, batch])
            token, stretch = rows["token"].combine_chunks(), rows["stretch"].to_numpy()
            last = int(_edges(token.dictionary_encode().indices.to_numpy(), stretch)[-1])
            if last:
                yield blocks(rows.slice(0, last).combine_chunks())
            held = rows.slice(last).combine_chunks().to_batches()
        if held:
            yield blocks(pa.Table.from_batches(held))

    return run


_BLOCKS = ["token", "stretch", "gaps", "times", "bucket"]


def store(texts: DataFrame, path: str) -> None:
    """Index texts (id bigint, text) below path: blocks, tokens (token, texts, times) and lengths (id, tokens). Null texts and ids are left out; an id that
    is repeated is one text, whose words are those of all its rows."""
    spark = ship(texts.sparkSession)
    held = texts.where("id IS NOT NULL AND text IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.lower("text").cast("binary").alias("b"))
    listed = written(held.mapInArrow(_listed(SPAN), "token string, stretch long, ids array<long>, times array<long>"), f"{path}/postings")
    dealt = listed.where("token IS NOT NULL").select(_bucket("token").alias("bucket"), "*").repartition("bucket", "stretch").sortWithinPartitions("bucket", "token", "stretch")
    blocks = dealt.mapInArrow(_joined(SPAN), "token string, stretch long, gaps array<int>, times array<int>, bucket int")
    blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    sums = spark.read.parquet(f"{path}/blocks").select("token", F.size("gaps").cast("long").alias("texts"), F.expr("aggregate(times, 0L, (a, x) -> a + x)").alias("times"))
    found = sums.groupBy("token").agg(F.sum("texts").alias("texts"), F.sum("times").alias("times"))
    found.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/tokens")
    sizes = listed.where("token IS NULL").select(F.explode(F.arrays_zip("ids", "times")).alias("x")).groupBy(F.col("x.ids").alias("id"))
    sizes.agg(F.sum("x.times").alias("tokens")).sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/lengths")


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(token, texts, times): every token with the texts that have it and how often it comes, from a table sorted by token."""
    return spark.read.parquet(f"{path}/tokens")


def postings(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """(token, id, n) of the given tokens, from their folders alone."""
    asked = spark.createDataFrame([(w,) for w in words], "token string")
    buckets = [r[0] for r in asked.select(_bucket("token")).distinct().collect()]
    blocks = spark.read.parquet(f"{path}/blocks").where(F.col("bucket").isin(buckets) & F.col("token").isin(list(words)))
    each = blocks.select("token", "stretch", F.posexplode(F.arrays_zip("gaps", "times")).alias("i", "x"))
    run = F.sum("x.gaps").over(W.partitionBy("token", "stretch").orderBy("i"))
    return each.select("token", (F.col("stretch") * SPAN + run).alias("id"), F.col("x.times").cast("bigint").alias("n"))


def search(spark: SparkSession, path: str, ranks: DataFrame, query: str, k: int = 10, prefix: bool = False) -> DataFrame:
    """(id, score, rank): the k texts that have all words of the query, by how often they have them, then by popularity rank, then by id.

    prefix: the last word stands for every token that begins with it, which the sorted table gives as one range. No word in the query: no rows.
    """
    words = re.findall(r"[a-z0-9]+", query.lower())
    whole = sorted(set(words[:-1] if prefix else words))
    found = [(w, w) for w in whole]
    if prefix and words:
        found += [(r["token"], f"{words[-1]}*") for r in tokens(spark, path).where(F.col("token").startswith(words[-1])).select("token").collect()]
    kinds = spark.createDataFrame(found, "token string, word string")
    hits = postings(spark, path, [t for t, _ in found]).join(F.broadcast(kinds), "token").groupBy("id", "word").agg(F.sum("n").alias("n"))
    per = hits.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("score")).where(F.col("words") == len(whole) + (prefix and bool(words)))
    return per.join(ranks, "id", "left").orderBy(F.desc("score"), F.col("rank").asc_nulls_last(), "id").limit(k).select("id", "score", "rank")
