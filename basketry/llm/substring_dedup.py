"""Removal of repeated passages with prefix-partitioned suffix trees.

A passage of WINDOW words repeats if the same words start a window in a document with a smaller doc_id. The
suffixes that begin at windows are split by prefixes of variable length into groups that memory holds:

* At first a window's prefix is the run of GRAM words in it with the least hash. All windows that share
  it, wherever in them it lies, are suffixes of the trees below it and of what stands just before it, so windows that
  lie next to each other travel as one bundle, with their words. Equal windows have equal prefixes; a prefix that
  no second document has holds no repeat and is pruned before any text moves.
* A prefix with more than `held` suffixes (counted over all documents) is lengthened: to the HALF words that all
  windows of one half of its bundles share, which splits the group and its bundles; and one with more than LONGER times as
  many to all WINDOW words. Below a prefix of that length stands a single node, of which only the least doc_id
  is asked: it is found by a combining aggregation, however many documents share it.

In a group the suffixes, as deep as their bundles reach, are sorted; the common depths of neighbours are the depths of
the tree's internal nodes. Each node of WINDOW words or more is a repeat, and covers that many words of its suffixes in every
document but that of its least doc_id; the deepest such node of a suffix makes the repeat maximal.

Words in a tree are compared as they are. Hashes only name groups, but for prefixes of WINDOW words, which are told apart by
128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, over_batches, partitions, ready, table, word_ids

#: Words of a window, of the first prefix and of the longer one; bundles hold so many windows at most at each length.
WINDOW, GRAM, HALF = 50, 16, 33
BUNDLES = (WINDOW - GRAM + 1, WINDOW - HALF + 1)
#: Suffixes in memory at a time, and below a prefix before it is lengthened, and how many times as many lengthen it to the whole window.
#: A suffix takes up to 340 bytes of a tree, below a longer prefix up to 270: 14 and 43 MB, and a few times that while they are sorted.
HELD, LONGER = 40_000, 4
P, Q = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, and where each text's words begin (one more for the end)."""
    at, words, offsets = word_ids(texts)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[at], offsets


def bounds_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends."""
    white = np.concatenate([[True], _WHITE[np.frombuffer(text, np.uint8)], [True]])
    return np.nonzero(white[:-1] & ~white[1:])[0], np.nonzero(~white[:-1] & white[1:])[0]


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _rolled(words: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of so many words."""
    part, done, out = words, 1, None
    have, left = 0, size
    while left:
        if left & 1:
            if out is None:
                out, have = part, done
            else:
                n = len(words) - have - done + 1
                out, have = out[:n] * _power(base, done) + part[have : have + n], have + done
        left >>= 1
        if left:
            n = len(words) - 2 * done + 1
            part = part[:n] * _power(base, done) + part[done : done + n]
            done *= 2
    return _mix(out)


def prefixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first prefix of each window, by hash, and where it lies in the text (the first place of equals)."""
    if len(words) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    least, width, want = _rolled(words, GRAM, P), 1, WINDOW - GRAM + 1
    at = np.arange(len(least))
    while width < want:
        step = min(width, want - width)
        left = least[:-step] <= least[step:]
        least, at = np.where(left, least[:-step], least[step:]), np.where(left, at[:-step], at[step:])
        width += step
    return least, at


def longer_prefixes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The prefix of HALF words of each window: from its first prefix on, or up to that prefix's end where that lies late in the window."""
    late = at - np.arange(len(at)) >= BUNDLES[1]
    start = at - np.where(late, HALF - GRAM + 1, 0)
    # A late prefix begins HALF - GRAM + 1 words or more into the window, so that HALF + 1 words up to its end are in it.
    runs = _rolled(words, HALF, P)
    return _mix(runs[start] * Q + late.astype(np.uint64))


def _docs(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("tk"), text.alias("text"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _chosen(listed: list | None) -> np.ndarray:
    return np.array(listed or [], np.int64).view(np.uint64)


def _counted(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, name, n): the first prefixes of each document's windows and how many windows have them."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, offsets = words_of(batch.column(1))
            found = [np.unique(prefixes(words[i:j])[0], return_counts=True) for i, j in zip(offsets, offsets[1:], strict=False)]
            at = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _signed(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([n for _, n in found]))], ["doc_id", "name", "n"])

        return each

    return over_batches(rows.select("doc_id", "text"), f"doc_id {kind}, name long, n long", make)


def _whole_windows(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, one, two): the windows, each once, whose first prefix is one of the row's `many`, by the hash of all their words."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            words, offsets = words_of(batch.column(1))
            at, found = [], []
            for d, (i, j, many) in enumerate(zip(offsets, offsets[1:], batch.column(2).to_pylist(), strict=False)):
                first, _ = prefixes(words[i:j])
                if len(first):
                    mine = np.isin(first, _chosen(many))
                    x = np.unique(np.stack([_rolled(words[i:j], WINDOW, b)[mine] for b in (P, Q)], axis=1), axis=0)
                    at.append(np.full(len(x), d))
                    found.append(x)
            if not at:
                return None
            whole = np.concatenate(found)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))), *(_signed(np.ascontiguousarray(c)) for c in whole.T)], ["doc_id", "one", "two"])

        return each

    return over_batches(rows.select("doc_id", "text", "many"), f"doc_id {kind}, one long, two long", make)


def _bundles(rows: DataFrame, kind: str) -> DataFrame:
    """(name, doc_id, tk, start, n, words): runs of windows with one prefix, one of the row's `few` or a longer one where the first is in `longer`, and their words as they stand."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            words, offsets = words_of(batch.column(2))
            at, name, start, size, text = [], [], [], [], []
            lists = (batch.column(i).to_pylist() for i in (3, 4))
            for d, (i, j, few, longer) in enumerate(zip(offsets, offsets[1:], *lists, strict=False)):
                first, place = prefixes(words[i:j])
                if not len(first):
                    continue
                raw = batch.column(2)[d].as_buffer().to_pybytes()
                begins, ends = bounds_of(raw)
                for wanted, most in ((few, BUNDLES[0]), (longer, BUNDLES[1])):
                    if not wanted:
                        continue
                    mine = np.isin(first, _chosen(wanted))
                    names = first if wanted is few else longer_prefixes(words[i:j], place)
                    cuts = np.nonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (mine[1:] != mine[:-1])]))[0]
                    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(names)], strict=True):
                        if mine[a]:
                            for lo in range(a, b, most):
                                hi = min(lo + most, b)
                                at.append(d)
                                name.append(names[lo])
                                start.append(lo)
                                size.append(hi - lo)
                                text.append(raw[begins[lo] : ends[hi + WINDOW - 2]])
            if not at:
                return None
            rows = batch.take(pa.array(at))
            return pa.RecordBatch.from_arrays(
                [_signed(np.array(name, np.uint64)), rows.column(0), rows.column(1), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(text, pa.binary()).cast(pa.string())],
                ["name", "doc_id", "tk", "start", "n", "words"],
            )

        return each

    return over_batches(rows.select("doc_id", "tk", "text", "few", "longer"), f"name long, doc_id {kind}, tk long, start long, n int, words string", make)


def _nodes(ids: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For sorted suffixes the depth of the deepest node above each that holds a suffix of a smaller id; 0 where none is WINDOW deep.

    ids: each suffix's document; common: its common depth with the suffix before it.
    """
    covered = np.zeros(len(ids), np.int64)
    at, depth = np.arange(len(ids)), common.copy()
    for d in np.unique(common[common >= WINDOW]).tolist():
        # What is linked at this depth or more lies below one node of it.
        first = depth < d
        first[0] = True
        firsts = np.nonzero(first)[0]
        sizes = np.diff([*firsts, len(at)])
        least = np.repeat(np.minimum.reduceat(ids[at], firsts), sizes)
        covered[at[least < ids[at]]] = d
        inner = np.repeat(sizes > 1, sizes)
        at, depth = at[inner], depth[inner]
    return covered


def _subtrees(ids: np.ndarray, name: np.ndarray, start: np.ndarray, n: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end): the words of each bundle that nodes with a smaller doc_id cover, from the suffix trees of whole groups."""
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    lengths = n + WINDOW - 1
    reach, deep = (lengths[row] - inside).astype(np.int32), int(lengths.max())
    coded = pc.ascii_split_whitespace(texts).flatten().dictionary_encode().indices.to_numpy()
    flat = np.concatenate([coded, np.full(deep, -1, np.int32)]).astype(np.int32)
    begins = np.cumsum(lengths) - lengths
    keyed = np.empty((len(row), 2 + deep), np.int32)
    keyed[:, :2] = name[row].view(np.int32).reshape(-1, 2)
    keyed[:, 2:] = np.lib.stride_tricks.sliding_window_view(flat, deep)[begins[row] + inside]
    keyed[:, 2:][np.arange(deep) >= reach[:, None]] = -1
    order = np.argsort(keyed.view(f"V{4 * (2 + deep)}").ravel(), kind="stable")
    keyed = keyed[order]
    apart = keyed[1:] != keyed[:-1]
    apart[:, 2:] |= keyed[1:, 2:] < 0
    common = np.where(apart.any(axis=1), apart.argmax(axis=1) - 2, deep)
    covered = np.empty(len(row), np.int64)
    covered[order] = _nodes(ids[row][order], np.concatenate([[0], common]))
    some = covered > 0
    if not some.any():
        return (np.empty(0, np.int64),) * 3
    edges = np.concatenate([[True], row[1:] != row[:-1]])
    runs = np.nonzero(some & np.concatenate([[True], ~some[:-1] | edges[1:]]))[0]
    lo = start[row] + inside
    return row[runs], lo[runs], np.maximum.reduceat(np.where(some, lo + covered, 0), runs)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over bundles sorted by name: (doc_id, tk, lo, hi) of the words covered, some whole groups at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        if not rows.num_rows:
            return
        texts = rows["words"].combine_chunks()
        row, lo, hi = _subtrees(rows["doc_id"].to_numpy(), rows["name"].to_numpy(), rows["start"].to_numpy(), rows["n"].to_numpy().astype(np.int64), texts)
        if len(row):
            some = rows.select(["doc_id", "tk"]).take(pa.array(row))
            yield from pa.table({"doc_id": some["doc_id"], "tk": some["tk"], "lo": pa.array(lo), "hi": pa.array(hi)}).combine_chunks().to_batches()

    for batch in batches:
        held.append(batch)
        size += pc.sum(batch.column(4)).as_py() or 0
        if size >= HELD:
            rows = pa.Table.from_batches(held)
            names = rows["name"].to_numpy()
            whole = int(np.searchsorted(names, names[-1], "left"))
            if whole:
                yield from work(rows.slice(0, whole))
                held = pa.table(rows.slice(whole).combine_chunks()).to_batches()
                size = sum(pc.sum(b.column(4)).as_py() for b in held)
    if held:
        yield from work(pa.Table.from_batches(held))


def _lists(names: DataFrame, held: int) -> DataFrame:
    """(doc_id, few, longer, many): each document's first prefixes that another has too, by the suffixes below them: held at most, LONGER times that, and more."""
    counted = names.groupBy("name").agg(F.sum("n").alias("s"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = cut(counted.where("least < most").select("name", "s"))
    one, two = F.col("s") <= held, F.col("s") <= LONGER * held
    listed = (F.collect_list(F.when(c, F.col("name"))).alias(n) for c, n in ((one, "few"), (~one & two, "longer"), (~two, "many")))
    return cut(names.select("doc_id", "name").join(shared, "name").groupBy("doc_id").agg(*listed))


def repeated(docs: DataFrame, held: int = HELD, dealt: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, tk, lo, hi): spans of words, lo to hi - 1, that smaller doc_ids cover (tk: the text's xxhash64), and
    (doc_id, one, two): the windows that repeat a smaller doc_id's below prefixes of WINDOW words, None if there are no such prefixes.

    dealt: the rows of _docs(docs) with a doc_id, already partitioned by it, if the caller has use for them too.
    """
    spark = ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _docs(docs).where(F.col("doc_id").isNotNull()) if dealt is None else dealt
    lists = _lists(cut(_counted(_docs(docs).where(F.col("doc_id").isNotNull()), kind)), held)
    again, hot = None, lists.where(F.size("many") > 0)
    if not hot.isEmpty():
        whole = _whole_windows(rows.join(hot.select("doc_id", "many"), "doc_id"), kind)
        least = whole.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
        again = whole.join(least, ["one", "two"]).where("least < doc_id").select("doc_id", "one", "two")
    some = rows.join(lists.where("size(few) > 0 OR size(longer) > 0").select("doc_id", "few", "longer"), "doc_id")
    bundles = _bundles(some, kind).repartition(partitions(spark), "name").sortWithinPartitions("name")
    return bundles.mapInArrow(_search, f"doc_id {kind}, tk long, lo long, hi long"), again


def drop_repeats(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(doc_id, n_words, n_removed, text): each document's words, joined by one space, without those that repeat an earlier document.

    Words are runs of anything but ASCII white space, and stay as they are. All windows are judged on the
    input. Null and empty texts have no words and give the empty text; texts of fewer than WINDOW words
    lose nothing, nor do rows without doc_id. Rows that repeat a doc_id don't repeat one another, and a text does not
    repeat itself. Texts of any length are read whole. An empty table gives no rows; other columns are passed over.
    """
    spark = ready(docs.sparkSession)
    rows = _docs(docs)
    # Texts are dealt out by doc_id once, for the search and for the removal.
    dealt = rows.where(F.col("doc_id").isNotNull()).repartition(partitions(spark), "doc_id")
    found, again = repeated(docs, held, dealt)
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("tk", "lo", "hi")).alias("spans"))
    of_text = F.filter("spans", lambda x: x["tk"] == F.col("tk"))
    none = F.lit(None).cast("array<bigint>")
    joined = dealt.join(spans, "doc_id", "left")
    if again is None:
        joined = joined.withColumn("one", none).withColumn("two", none)
    else:
        windows = again.groupBy("doc_id").agg(F.collect_list(F.struct("one", "two")).alias("w"))
        joined = joined.join(windows.select("doc_id", F.col("w.one").alias("one"), F.col("w.two").alias("two")), "doc_id", "left")
    joined = joined.select("doc_id", "text", of_text["lo"].alias("lo"), of_text["hi"].alias("hi"), "one", "two")
    joined = joined.unionAll(rows.where(F.col("doc_id").isNull()).select("doc_id", "text", none, none, none, none))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            total, removed, kept = [], [], []
            for text, lo, hi, one, two in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                words = text.encode().split()
                total.append(len(words))
                if lo or one:
                    depth = np.zeros(len(words) + 1, np.int64)
                    if one:
                        hashes, _ = words_of(pa.array([text]))
                        whole = np.stack([_rolled(hashes, WINDOW, b) for b in (P, Q)], axis=1)
                        wanted = np.stack([_chosen(one), _chosen(two)], axis=1)
                        at = np.nonzero(np.isin(whole.view("V16").ravel(), wanted.view("V16").ravel()))[0]
                        np.add.at(depth, at, 1)
                        np.add.at(depth, at + WINDOW, -1)
                    np.add.at(depth, lo or [], 1)
                    np.add.at(depth, hi or [], -1)
                    stays = np.cumsum(depth)[:-1] == 0
                    words = [words[i] for i in np.nonzero(stays)[0].tolist()]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_batches(joined, f"doc_id {kind}, n_words long, n_removed long, text string", make)


def op8_substring_dedup(spark, sf_dir):
    """Each document's words, words removed and the SHA-256 of what stays. Null and empty texts count no words; ties don't arise, as of
    documents with a passage the smallest doc_id keeps it; repeated rows are each answered; an empty table gives no rows."""
    kept = drop_repeats(table(ready(spark), sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
