"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct 64-bit fingerprints are turned so that each of k + 1 bit blocks comes first once (two
fingerprints at k or fewer differing bits agree in a whole block), and sorted by the rank that they
have in the reflected Gray order. Fingerprints with the same leading block form one upper node of
the index. Below it, nodes hold the mask of the bits that all their fingerprints share and the
pattern there; a pair of nodes whose shared bits already differ in more than k places is pruned with
all that it holds. Nodes are searched against each other, and only a forest of links leaves a group.

An upper node that holds more fingerprints than one task should take is not searched but linked
through hubs, which loses nothing either: two fingerprints differ in at most 2 bits exactly when both
lie within one bit of some common point. A hub gathers at most 65 fingerprints, however dense they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let_go, over_batches, packed, partitions, raw_text, ready, table, unpacked, word_ids
from .graph import components

#: Shingles counted at a time, fingerprints in a leaf, and in an upper node that one task searches.
CHUNK, LEAF, NODE = 1 << 16, 32, 1024
SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The majority bits of the XXH64 values of a text's word shingles (A-Z lower-cased); 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i : len(part) - shingle + 1 + i] for i in range(shingle)), strict=True)) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null and empty texts have fingerprint 0."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_batches(docs.select("doc_id", raw_text().alias("b")), f"doc_id {kind}, fp long", make)


def blocks_of(k: int) -> list[tuple[int, int]]:
    """For each of k + 1 blocks that cover 64 bits: how far to turn left to bring it first, and its width."""
    ends = [64 * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _gray_rank(code: F.Column) -> F.Column:
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code


class _Node:
    """fps[lo:hi], which lie together in Gray order, with the bits that they share."""

    __slots__ = ("hi", "kids", "lo", "mask", "pattern")

    def __init__(self, fps: np.ndarray, lo: int, hi: int):
        self.lo, self.hi, self.kids = lo, hi, []
        part = fps[lo:hi]
        every, some = int(np.bitwise_and.reduce(part)), int(np.bitwise_or.reduce(part))
        self.mask = ~(every ^ some) & (2**64 - 1)
        self.pattern = every & self.mask
        if hi - lo > LEAF:
            mid = (lo + hi) // 2
            self.kids = [_Node(fps, lo, mid), _Node(fps, mid, hi)]


def _search(fps: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Links (i, root of i) that join all fingerprints of one upper node that lie within k bits, through others there."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    top = _Node(fps, 0, len(fps))
    todo = [(top, top)]
    while todo:
        x, y = todo.pop()
        if ((x.pattern ^ y.pattern) & x.mask & y.mask).bit_count() > k:
            continue
        if x is y and x.kids:
            a, b = x.kids
            todo += [(a, a), (b, b), (a, b)]
        elif x.kids and (not y.kids or x.hi - x.lo >= y.hi - y.lo):
            todo += [(kid, y) for kid in x.kids]
        elif y.kids:
            todo += [(x, kid) for kid in y.kids]
        else:
            near = np.bitwise_count(fps[x.lo : x.hi, None] ^ fps[None, y.lo : y.hi]) <= k
            for i, j in zip(*np.nonzero(near), strict=True):
                a, b = find(x.lo + int(i)), find(y.lo + int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)
    return [(i, find(i)) for i in range(len(fps)) if find(i) != i]


def _search_groups(k: int):
    """For mapInArrow over (key, block, id, fp) sorted by key, block and rank: the links of every upper node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        key = None

        def links(out: list) -> None:
            ids, fps = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0),) * 2
            if len(ids) > 1:
                if found := _search(fps.view(np.uint64), k):
                    i, j = np.array(found).T
                    out.append((ids[i], ids[j]))

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(2)], axis=1)
            ids, fps = (batch.column(i).to_numpy() for i in (2, 3))
            cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(ids)]
            out: list = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (now := tuple(keys[a])) != key:
                    links(out)
                    held, key = [], now
                held.append((ids[a:b], fps[a:b]))
            if out:
                yield batch_of(out)
        out = []
        links(out)
        if out:
            yield batch_of(out)

    return run


def links(rows: DataFrame, k: int = 2, n: int | None = None, node: int = NODE) -> DataFrame:
    """(a, b): links between the ids of rows (seed, id, fp) that connect those of a seed whose fps lie within k bits of each other.

    Ids with the same fp are not linked through it: an id stands for its fp. A node counts as dense beyond node rows,
    or beyond a task's fair share (of n tasks, by default the shuffle partitions) of all rows where that is more.
    """
    if not 0 <= k <= 2:
        raise ValueError("the hubs for dense nodes reach 2 differing bits")
    n = n or partitions(rows.sparkSession)
    turned = F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(by).alias("by"), F.lit(w).alias("width")) for i, (by, w) in enumerate(blocks_of(k))))
    dealt = rows.select("seed", "id", "fp", F.explode(turned).alias("t")).select(
        (F.col("seed") * 8 + F.col("t.turn")).cast("long").alias("key"),
        F.expr("shiftleft(fp, t.by) | IF(t.by = 0, 0L, shiftrightunsigned(fp, 64 - t.by))").alias("code"),
        F.col("t.width").alias("width"),
        "seed",
        "id",
        "fp",
    )
    dealt = dealt.select("key", F.expr("shiftrightunsigned(code, 64 - width)").alias("block"), _gray_rank(F.col("code")).alias("rank"), "seed", "id", "fp")
    sizes = cut(dealt.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    most = max(node, total // n)
    dealt = dealt.join(sizes, ["key", "block"])
    if largest > most:
        dealt = cut(dealt)
    small = dealt.where(F.col("n") <= most)
    small = small.repartition(n, "key", "block").sortWithinPartitions("key", "block", "rank", "id")
    found = small.select("key", "block", "id", "fp").mapInArrow(_search_groups(k), "a long, b long")
    if largest <= most:
        return found.distinct()
    dense = dealt.where(F.col("n") > most).select("seed", "id", "fp").distinct()
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    places = F.sequence(F.lit(0), F.lit(63))
    if k == 2:
        near = F.concat(F.array("fp"), F.transform(places, lambda i: F.col("fp").bitwiseXOR(bit(i))))
        hubs = dense.select("seed", "id", F.explode(near).alias("hub"), F.lit(-1).alias("bit"))
    elif k == 1:
        near = F.transform(places, lambda i: F.struct(i.alias("bit"), F.col("fp").bitwiseAND(F.bitwise_not(bit(i))).alias("hub")))
        hubs = dense.select("seed", "id", F.explode(near).alias("h")).select("seed", "id", "h.hub", "h.bit")
    else:
        hubs = dense.select("seed", "id", F.col("fp").alias("hub"), F.lit(-1).alias("bit"))
    first = cut(hubs.groupBy("seed", "hub", "bit").agg(F.min("id").alias("b"), F.max("id").alias("most")).where("b < most").drop("most"))
    linked = hubs.join(first, ["seed", "hub", "bit"]).select(F.col("id").alias("a"), "b").where("a <> b")
    return found.unionByName(linked).distinct()


def near_groups(docs: DataFrame, k: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): documents linked, directly or through others, by fingerprints at k or fewer differing bits.

    component_id is the smallest doc_id of the group. Null and empty texts share fingerprint 0 and are
    linked like any others. Rows that repeat a doc_id each give a row; an empty table gives none.
    """
    ready(docs.sparkSession)
    prints = cut(fingerprints(docs, shingle))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = cut(distinct)
    roots = components(links(distinct.select(F.lit(0).alias("seed"), F.col("fp").alias("id"), "fp"), k))
    named = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = cut(named.groupBy("root").agg(F.min("first").alias("component_id")))
    of = cut(named.select("fp", "root").join(smallest, "root").select("fp", "component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


#: For near_copies: the words of a shingle, bands of a text's shingles, least hashes in a band, and the similarity that makes
#: near copies. Two texts at similarity s share a band with probability 1 - (1 - s ** WIDTH) ** BANDS: 0.99993 at 0.8.
SHINGLE, BANDS, WIDTH, SIMILAR = 5, 24, 5, 0.8
#: Bytes of texts that are compared in memory at a time, and texts of a larger cluster that all of its blocks are compared with.
BLOCK, PIVOTS = 8 << 20, 8
_MIX, _TURN = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
_WAYS = np.random.default_rng(SEED).integers(1, 2**63, BANDS * WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _TURN)) * _MIX
    return x ^ (x >> _TURN)


def bands(text: bytes) -> tuple[np.ndarray, int]:
    """The names of a text's BANDS bands, each made of the WIDTH least hashes of its shingles under other ways of mixing, and the number of its shingles."""
    words = text.lower().split()
    row = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    n = max(1, len(row) - SHINGLE + 1) if words else 0
    grams = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(row))):
        grams = (grams * np.uint64(0x9E3779B97F4A7C15)) ^ (row[i : i + n] + (row[i : i + n] >> np.uint64(29)))
    grams = np.unique(grams)
    least = np.full(BANDS * WIDTH, 2**64 - 1, np.uint64)
    for at in range(0, len(grams), CHUNK // 128):
        least = np.minimum(least, _mixed(grams[at : at + CHUNK // 128, None] * _WAYS).min(axis=0))
    names = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, WIDTH).T:
        names = _mixed(names * np.uint64(0x9E3779B97F4A7C15) + part)
    return names, len(grams)


def _shingles(texts: pa.Array, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, first, n): the set of each text's shingles, tokens[first[i]:first[i] + n[i]], rarest first; shingles of different clusters differ.

    A-Z are lower-cased. A text of fewer words than a shingle has is one shingle; so is one without words.
    """
    words, different, offsets = word_ids(pc.ascii_lower(texts))
    size = np.diff(offsets)
    longer = np.maximum(size, SHINGLE)
    begin = np.cumsum(longer) - longer
    line = np.full(int(longer.sum()), len(different), np.int64)
    line[np.repeat(begin - offsets[:-1], size) + np.arange(len(words))] = words
    # Runs of two, four and then five words, numbered exactly.
    number = lambda x: np.unique(x, return_inverse=True)[1]
    two = number(line[:-1] * (len(different) + 1) + line[1:])
    four = number(two[:-2] * (two.max() + 1) + two[2:])
    five = number(four[: len(line) - 4] * (len(different) + 1) + line[4:])
    text = np.repeat(np.arange(len(size)), longer - SHINGLE + 1)
    at = np.repeat(begin, longer - SHINGLE + 1) + np.arange(len(text)) - np.repeat(np.cumsum(longer - SHINGLE + 1) - (longer - SHINGLE + 1), longer - SHINGLE + 1)
    kinds = number(cluster[text] * (five.max() + 1) + five[at])
    pairs = np.unique(text * (kinds.max() + 1) + kinds)
    text, kinds = pairs // (kinds.max() + 1), pairs % (kinds.max() + 1)
    often = np.bincount(kinds)
    rank = np.empty(len(often), np.int64)
    rank[np.lexsort((np.arange(len(often)), often))] = np.arange(len(often))
    tokens = np.sort(text * len(often) + rank[kinds]) % len(often)
    n = np.bincount(text, minlength=len(size))
    return tokens, np.cumsum(n) - n, n


def _near(texts: pa.Array, cluster: np.ndarray, root: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """For each text the place of one that stands for its group: texts of a cluster are joined whose similarity is SIMILAR or more.

    root: texts with the same are joined already; only pairs with a text that asks are compared. Two such texts share one of the
    rarest shingles of each that leave fewer than it takes, so others aren't compared.
    """
    tokens, first, n = _shingles(texts, cluster)
    prefix = n - np.ceil(SIMILAR * n - 1e-9).astype(np.int64) + 1
    text = np.repeat(np.arange(len(n)), n)
    early = np.arange(len(tokens)) - first[text] < prefix[text]
    held, having = tokens[early], text[early]
    order = np.argsort(held, kind="stable")
    having = having[order]
    count = np.bincount(held, minlength=int(tokens.max()) + 1)
    begin = np.cumsum(count) - count
    root = root.copy()
    mark, met = np.zeros(len(count), bool), np.full(len(n), -1)
    for x in np.unique(text[early][(count[held] > 1) & asks[text[early]]]).tolist():
        mine = tokens[first[x] : first[x] + n[x]]
        mark[mine] = True
        for t in mine[: prefix[x]].tolist():
            if count[t] < 2:
                continue
            others = having[begin[t] : begin[t] + count[t]]
            others = others[(root[others] != root[x]) & (met[others] != x)]
            others = others[(n[others] >= SIMILAR * n[x] - 1e-9) & (n[x] >= SIMILAR * n[others] - 1e-9) & (~asks[others] | (others < x))]
            met[others] = x
            some = 8
            while len(others):
                part, others = others[:some], others[some:]
                at = np.repeat(first[part], n[part]) + np.arange(n[part].sum()) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                both = np.add.reduceat(mark[tokens[at]].astype(np.int64), np.cumsum(n[part]) - n[part])
                for y in part[both / (n[x] + n[part] - both) >= SIMILAR].tolist():
                    if root[y] != root[x]:
                        root[root == root[y]] = root[x]
                others = others[root[others] != root[x]]
                some = min(2 * some, 4096)
        mark[mine] = False
    return root


def _compared(dealt: DataFrame) -> DataFrame:
    """(a, b): links of dealt (key, id, asks, joined, text), sorted by key: the texts of a key are compared, as many keys at a time as BLOCK holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: list[pa.RecordBatch] = []
        size = 0

        def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if not rows.num_rows:
                return
            rows = rows.combine_chunks()
            key, joined = (np.unique(rows[c].to_numpy(), return_inverse=True)[1] for c in ("key", "joined"))
            # A text that stands for those joined already must be one of the key.
            _, stands = np.unique(key * (joined.max() + 1) + joined, return_index=True)
            root = stands[np.unique(key * (joined.max() + 1) + joined, return_inverse=True)[1]]
            after = _near(rows["text"].combine_chunks(), key, root, rows["asks"].to_numpy())
            new = np.nonzero(after != np.arange(len(after)))[0]
            if len(new):
                ids = rows["id"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(ids[after[new]])], ["a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.column(4).nbytes
            if size >= BLOCK:
                rows = pa.Table.from_batches(held)
                keys = rows["key"].to_numpy()
                whole = int(np.searchsorted(keys, keys[-1], "left"))
                if whole:
                    yield from work(rows.slice(0, whole))
                    held = rows.slice(whole).combine_chunks().to_batches()
                    size = sum(b.column(4).nbytes for b in held)
        if held:
            yield from work(pa.Table.from_batches(held))
        pa.default_memory_pool().release_unused()

    return dealt.select("key", "id", "asks", "joined", "text").mapInArrow(run, "a long, b long")


def named_texts(docs: DataFrame, name=lambda sha: F.xxhash64(sha)) -> DataFrame:
    """packed(docs) with sha, the SHA-256 of the text (null: empty), and id: a long that two different texts never share.

    The id is a hash of sha; where two texts' ids are alike, all texts with that id get others, until none are.
    """
    rows = packed(docs).withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("id", name(F.col("sha")))
    salt = 0
    while True:
        clash = rows.select("id", "sha").groupBy("id").agg((F.min("sha") != F.max("sha")).alias("two")).where("two").select("id")
        if (clash := cut(clash)).isEmpty():
            return rows
        salt += 1
        rows = rows.join(clash.withColumn("two", F.lit(True)), "id", "left")
        rows = rows.withColumn("id", F.when(F.col("two"), F.xxhash64(F.lit(salt), "sha")).otherwise(F.col("id"))).drop("two")


def near_copies(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, root): those of the texts (id, text), each id the name of one text, that are near copies of others, with a name for their group.

    Texts whose SimHash fingerprints of five-word shingles differ in at most two bits (found by the Gray-order index), or that share a band, directly
    or through others, make a cluster: bands find what was cut, lengthened or is short. Two texts of a cluster are linked if their sets of five-word shingles
    have a Jaccard similarity of 0.8 or more, counted exactly; what links join is a group. Every text goes once to where its cluster is compared
    in memory. A cluster of more than block bytes is compared in blocks: at first each within itself and with PIVOTS texts of the cluster, then
    those outside the cluster's largest group, block by block, with all of the cluster. Texts without words are near copies of each other.
    """
    spark = ready(texts.sparkSession)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            names, _ = zip(*map(bands, texts), strict=True)
            prints = np.fromiter((fingerprint(t, SHINGLE) for t in texts), np.uint64, len(texts))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(texts)), BANDS + 1)))
            printed = np.tile(np.arange(BANDS + 1) == BANDS, len(texts))
            return pa.RecordBatch.from_arrays([ids, pa.array(printed), pa.array(np.column_stack([np.stack(names), prints]).ravel().view(np.int64))], ["id", "printed", "name"])

        return each

    # A text's fingerprint goes with the names of its bands.
    dealt = cut(over_batches(texts.select("id", raw_text().alias("b")), "id long, printed boolean, name long", make))
    shared = dealt.groupBy("printed", "name").agg(F.min("id").alias("pivot"), F.max("id").alias("most")).where("pivot < most").drop("most")
    firsts = cut(dealt.where("printed").groupBy("name").agg(F.min("id").alias("id")))
    near = links(firsts.select(F.lit(0).alias("seed"), "id", F.col("name").alias("fp")))
    joined = dealt.join(shared, ["printed", "name"]).select("id", "pivot").unionByName(near.toDF("id", "pivot"))
    clusters = components(joined.where("id <> pivot"), "id", "pivot")
    clusters = clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    bodies = texts.select("id", "text").join(clusters, "id").dropDuplicates(["id"])
    sizes = clusters.join(texts.select("id", F.octet_length("text").alias("size")).dropDuplicates(["id"]), "id").groupBy("cluster").agg(F.sum("size").alias("size"))
    large = sizes.where(F.col("size") > block).select("cluster", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    large = cut(large)
    n = partitions(spark)

    def in_keys(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "key").sortWithinPartitions("key", "id")

    some = large.isEmpty()
    plain = bodies if some else bodies.join(large, "cluster", "left_anti")
    row = lambda key, asks: (key.alias("key"), F.col("id"), asks.alias("asks"), F.col("id").alias("joined"), F.col("text"))
    found = cut(_compared(in_keys(plain.select(*row(F.col("cluster"), F.lit(True))))))
    if some:
        return found.select(F.col("a").alias("id"), F.col("b").alias("root"))
    within = bodies.join(large, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    least = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("id"), "id"))
    pivots = within.select("cluster", "id").withColumn("r", least).where(F.col("r") <= PIVOTS).select("id")
    first = within.select("cluster", "id", "text", "block").unionByName(
        within.join(F.broadcast(cut(pivots)), "id").select("cluster", "id", "text", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("other <> block").select("cluster", "id", "text", F.col("other").alias("block"))
    )
    found = found.unionByName(cut(_compared(in_keys(first.select(*row(F.xxhash64("cluster", "block"), F.lit(True)))))))
    joined = components(found)
    # The largest group of each large cluster; the others' texts ask all of the cluster, in blocks of both.
    at = within.select("id", "cluster", "blocks", "block", F.octet_length("text").alias("size")).join(joined, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    at = cut(at)
    most = at.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "root")).alias("most")).select("cluster", F.col("most.root").alias("most"))
    asking = at.join(most, "cluster").where("root <> most")
    turns = cut(asking.groupBy("cluster").agg(F.ceil(F.sum("size") / block).cast("int").alias("turns")))
    asking = cut(asking.join(turns, "cluster").select("id", "root", "cluster", "blocks", F.pmod(F.xxhash64("id", F.lit(1)), "turns").cast("int").alias("turn")))
    every = at.join(turns, "cluster").select("id", "root", "cluster", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("asks"))
    asks = asking.select("id", "root", "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "turn", F.lit(True).alias("asks"))
    both = every.unionByName(asks).groupBy("id", "root", "cluster", "block", "turn").agg(F.max("asks").alias("asks"))
    sent = both.join(within.select("id", "text"), "id").select(F.xxhash64("cluster", "block", "turn").alias("key"), "id", "asks", F.col("root").alias("joined"), "text")
    found = found.unionByName(cut(_compared(in_keys(sent))))
    return components(found).select(F.col("node").alias("id"), "root")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id, and all other rows; all columns stay.

    Rows with equal texts are near copies; null counts as empty, and texts without words are near copies of each other. A null doc_id
    comes last in its group; of rows that repeat the doc_id, that with the least text digest stays, then that with the least hash of all
    its columns (those that differ in nothing are one). Texts of any length are compared whole. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    rows = named_texts(docs)
    groups = cut(near_copies(rows.select("id", "text")))
    marks = rows.select("id", "sha", "doc_id", "mark").join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha", "mark", "id")).alias("s")
    stays = cut(marks.groupBy("root").agg(least).select("s.id", "s.mark", F.col("s.doc_id").alias("of")))
    mine = (rows["id"] == stays["id"]) & (rows["mark"] == stays["mark"]) & rows["doc_id"].eqNullSafe(stays["of"])
    return unpacked(rows.drop("text").join(stays, mine, "left_semi").dropDuplicates(["id"]), docs.columns)


def op3_simhash(spark, sf_dir):
    """Each document's fingerprint and component. Null and empty texts have fingerprint zero and are linked like any others; repeated
    rows are each answered; ties don't arise, as a component is named by its smallest doc_id; an empty table gives no rows."""
    groups = near_groups(table(ready(spark), sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
