"""Benchmark decontamination: every training passage is a query against a BM25 inverted index of the test items.

The index holds at most ITEMS items at a time and is broadcast; a larger benchmark is searched block of
items by block, one index in memory at a time, under the statistics (items, their mean and greatest length, documents of a
term) of the whole benchmark, so that blocks change no score. A document's words are cut
into passages twice as long as the longest item, each half over the last, so that every item that
occurs lies whole in some passage. All pairs that reach SHARE of the item's score against itself
are retrieved, in the manner of block-max WAND, done for all passages of a batch at once: terms that
cannot bring any item over its threshold by themselves (the common ones) are set aside; the others' postings
bear the maximal impact of each term in a block of items, passages whose sum of maxima stays below what
the block's easiest item still needs are passed over with the block, and only the rest is scored item by item.

A retrieved pair counts if question and answer (an item's last sentence; or last third) are found:
their runs of words must be in the document, in the part around the passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, over_batches, packed, ready, table, unpacked

K1, B = 1.2, 0.75
#: Items in an index and in a block of it, the share of its own score that retrieves an item, and the least share of runs found.
ITEMS, BLOCK, SHARE, FOUND = 20_000, 8, 0.6, 0.8
#: Words in a run that question and answer are verified by.
RUN = 5
#: ASCII marks become spaces.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str) -> list[bytes]:
    """Case-folded words without ASCII marks, in UTF-8."""
    return text.casefold().encode("utf-8", "replace").translate(PLAIN).split()


def runs(of: list[bytes], size: int = RUN) -> set[tuple]:
    """The runs of size words; of fewer words the whole; of none, none."""
    if not of:
        return set()
    size = min(size, len(of))
    return set(zip(*(of[i:] for i in range(size)), strict=False))


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: its last sentence answers, or the last third of its words if it has but one."""
    parts = [p for p in (words(s) for s in SENTENCE.split(text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    whole = parts[0] if parts else []
    cut = len(whole) - len(whole) // 3
    return whole[:cut], whole[cut:]


class Index:
    """The inverted index of some items, (item_id, text); items without words are left out.

    whole: (items with words, mean and greatest number of words, items that hold each of these items' terms) of the benchmark that
    they are a block of; without it they are all of it.
    """

    def __init__(self, items: list[tuple], whole: tuple[int, float, int, dict[bytes, int]] | None = None):
        texts = [(i, t, words(t)) for i, t in items]
        texts = [x for x in texts if x[2]]
        self.ids = [i for i, _, _ in texts]
        self.parts = [tuple(map(runs, split_item(t))) for _, t, _ in texts]
        n = len(texts)
        counts = [Counter(w) for _, _, w in texts]
        own_df = Counter(t for c in counts for t in c)
        lengths = [len(w) for _, _, w in texts]
        total, mean, longest, df = whole or (n, sum(lengths) / max(n, 1), max(lengths, default=0), own_df)
        self.length = max(32, 2 * longest)
        self.terms = {t: j for j, t in enumerate(sorted(own_df))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        own = np.zeros(n)
        for i, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(texts[i][2]) / mean)
            for t, f in c.items():
                impact = math.log(1 + (total - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm)
                postings[self.terms[t]].append((i, impact))
                own[i] += impact
        self.threshold = SHARE * own
        # Common terms, from the longest list on: those that keep every item well below its threshold with them alone.
        common, sums = np.zeros(len(postings), bool), np.zeros(n)
        for j in sorted(range(len(postings)), key=lambda j: -len(postings[j])):
            at = np.array([i for i, _ in postings[j]])
            more = np.array([w for _, w in postings[j]])
            if (sums[at] + more >= 0.8 * self.threshold[at]).any():
                continue
            sums[at] += more
            common[j] = True
        self.rare = ~common
        self.needed = np.maximum(self.threshold - sums, 1e-9)
        self.first = np.cumsum([0, *map(len, postings)])
        self.item = np.array([i for p in postings for i, _ in p], np.int64)
        self.impact = np.array([w for p in postings for _, w in p])
        blocks = [Counter() for _ in postings]
        for j, p in enumerate(postings):
            for i, w in p:
                blocks[j][i // BLOCK] = max(blocks[j][i // BLOCK], w)
        self.block_first = np.cumsum([0, *map(len, blocks)])
        self.block = np.array([b for c in blocks for b in c], np.int64)
        self.most = np.array([w for c in blocks for w in c.values()])
        self.block_needs = np.array([self.needed[b : b + BLOCK].min() for b in range(0, n, BLOCK)])

    def _spread(self, first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each term the places of its postings, and which of terms each belongs to."""
        sizes = first[terms + 1] - first[terms]
        owner = np.repeat(np.arange(len(terms)), sizes)
        return first[terms][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner

    def retrieve(self, ids: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item, score) of all pairs at or above the threshold; ids: a document's terms, -1 where not in the index."""
        if not len(self.ids) or not len(ids):
            return []
        step = self.length // 2
        at = np.nonzero((ids >= 0) & self.rare[ids])[0]
        if not len(at):
            return []
        last = max(0, -(-(len(ids) - self.length) // step))
        over = at // step
        passage = np.concatenate([np.minimum(over, last), np.maximum(over - 1, 0)])
        keep = np.concatenate([over <= last, (over >= 1) & (over - 1 <= last)])
        pairs = np.unique(passage[keep] * len(self.terms) + np.concatenate([ids[at]] * 2)[keep])
        passage, term = pairs // len(self.terms), pairs % len(self.terms)
        where, owner = self._spread(self.block_first, term)
        nb = len(self.block_needs)
        keys, inverse = np.unique(passage[owner] * nb + self.block[where], return_inverse=True)
        open_ = np.bincount(inverse, self.most[where]) >= self.block_needs[keys % nb] - 1e-9
        if not open_.any():
            return []
        live = np.isin(passage, np.unique(keys[open_] // nb))
        where, owner = self._spread(self.first, term[live])
        n = len(self.ids)
        item, passage = self.item[where], passage[live][owner]
        some = np.isin(passage * nb + item // BLOCK, keys[open_])
        keys, inverse = np.unique(passage[some] * n + item[some], return_inverse=True)
        keys = keys[np.bincount(inverse, self.impact[where][some], len(keys)) >= self.needed[keys % n] - 1e-9] if len(keys) else keys
        out = []
        for key in keys.tolist():
            p, i = divmod(key, n)
            present = np.unique(ids[p * step : p * step + self.length])
            where, _ = self._spread(self.first, present[present >= 0])
            score = float(self.impact[where][self.item[where] == i].sum())
            if score >= self.threshold[i] - 1e-9:
                out.append((p, i, score))
        return out

    def matches(self, text: str) -> list[tuple]:
        """(item_id, passage_start, score, question_overlap, answer_overlap) of the items that a document holds, each at its best passage."""
        found = words(text)
        ids = np.fromiter((self.terms.get(w, -1) for w in found), np.int64, len(found))
        best: dict[int, tuple] = {}
        for p, i, score in self.retrieve(ids):
            begin = p * (self.length // 2)
            near = found[begin : begin + self.length]
            question, answer = self.parts[i]
            q, a = (len(x & runs(near, len(next(iter(x))))) / len(x) if x else 1.0 for x in (question, answer))
            if q >= FOUND and a >= FOUND and (i not in best or (score, -begin) > (best[i][2], -best[i][1])):
                best[i] = (self.ids[i], begin, score, q, a)
        return [best[i] for i in sorted(best)]


def _counted(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words) of each item that has any, and (term, df)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = [w for w in map(words, batch.column(0).to_pylist()) if w]
            df = Counter(t for w in found for t in set(w))
            rows = [(None, n, None) for n in map(len, found)] + [(t, None, n) for t, n in df.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["term", "words", "df"]) if rows else None

        return each

    counted = cut(over_batches(texts.select("text"), "term binary, words long, df long", make))
    return counted.where("term IS NULL").select("words"), cut(counted.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")))


def indexes(items: DataFrame, size: int = ITEMS) -> Iterator[Index]:
    """Indexes of at most about size items each, made one after another, which together hold all items; null texts are in none."""
    texts = items.where(F.col("text").isNotNull()).select("item_id", "text")
    rows = lambda block: sorted(((r["item_id"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    total = texts.count()
    if total <= size:
        yield Index(rows(texts))
        return
    lengths, df = _counted(texts)
    n, mean, longest = lengths.agg(F.count("words"), F.sum("words") / F.count("words"), F.max("words")).first()
    if not n:
        return
    # Twice the blocks that would do, for hashing deals items out unevenly.
    parts = 2 * -(-total // size)
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for i in range(parts):
        block = rows(texts.where(block_of == i))
        terms = {t for _, text in block for t in words(text)}
        known = items.sparkSession.createDataFrame([(t,) for t in terms], "term binary")
        yield Index(block, (n, mean, longest, {bytes(r["term"]): r["df"] for r in df.join(known, "term").collect()}))


def leaks(docs: DataFrame, items: DataFrame, size: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, passage_start, score, question_overlap, answer_overlap): one row for each item that a document holds.

    passage_start is the place of the passage's first word, of the best passage or, of equal ones, the first. Null and empty texts
    hold nothing, items that are null or have no words are in no document, and an item that comes twice is found twice, as are
    items of repeated rows of docs. Texts of any length are read whole; other columns are passed over. An empty
    table, of documents or of items, gives no rows.
    """
    spark = ready(docs.sparkSession)
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (items, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, passage_start long, score double, question_overlap double, answer_overlap double"
    types = (None, pa.int64(), pa.float64(), pa.float64(), pa.float64())

    def of(shared) -> DataFrame:
        def make():
            def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                found = [(i, m) for i, t in enumerate(batch.column(1).to_pylist()) for m in shared.value.matches(t)]
                if not found:
                    return None
                cols = zip(*(m for _, m in found), strict=True)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found])), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], ["doc_id", "item_id", "passage_start", "score", "question_overlap", "answer_overlap"])

            return each

        return over_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("b")), schema, make)

    out = None
    for shared, last in _broadcast_in_turn(spark, items, size):
        found = of(shared) if last else cut(of(shared))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _broadcast_in_turn(spark, items: DataFrame, size: int) -> Iterator[tuple]:
    """(broadcast index, whether it is the only one): each is let go when the next is asked for."""
    made = indexes(items, size)
    first = next(made, None)
    if first is None:
        return
    index = next(made, None)
    shared = spark.sparkContext.broadcast(first)
    yield shared, index is None
    while index is not None:
        shared.unpersist()
        shared = spark.sparkContext.broadcast(index)
        yield shared, False
        index = next(made, None)


def drop_leaks(docs: DataFrame, items: DataFrame, size: int = ITEMS) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns; each is judged where it lies.

    Null and empty texts hold nothing; repeated rows are each judged; an empty table, of documents or of items, loses no rows.
    """
    spark = ready(docs.sparkSession)
    rows = packed(docs).select("row", "text")
    schema = rows.schema

    def of(rows: DataFrame, shared) -> DataFrame:
        def make():
            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                return batch.filter(pa.array([not shared.value.matches(t) for t in batch.column(1).to_pylist()], pa.bool_()))

            return each

        return over_batches(rows, schema, make)

    for shared, last in _broadcast_in_turn(spark, items, size):
        rows = of(rows, shared) if last else cut(of(rows, shared))
    return unpacked(rows, docs.columns)


def op9_decontaminate(spark, sf_dir):
    """One row for each benchmark item that a document holds, at its best passage. Null texts hold nothing; repeated rows of either table
    are each found; of equal passages the first is told; an empty table gives no rows."""
    return leaks(*(table(ready(spark), sf_dir, t) for t in ("documents", "benchmark")))
