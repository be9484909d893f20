"""Sequence packing as a cutting-stock problem, solved by column generation.

Documents become token ids; those longer than a sequence are cut at its length, and what remains is
a piece of some length. Lengths are rounded up to multiples of UNIT, which leaves a histogram of a
fixed number of classes whatever the corpus. The linear program over cutting patterns of that
histogram is solved on the driver by revised simplex; a knapsack dynamic program prices new patterns
by the duals. Patterns are rounded down, and the few pieces left over are packed by first fit.

Each class's pieces are ranked without any single task or window over a class: pieces are dealt into
as many salts as there are shuffle partitions, ranked within those, and shifted by the running counts.
A rank then names pattern, sequence and slot by arithmetic.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, of_worker, over_batches, partitions, ready, table

LENGTH, UNIT, END = 4096, 16, 2
TOKENIZER = "word_bpe_49k.json"
#: Words that a worker remembers, the longest of them, and marks that are parted from the end of a word (no apostrophe: it may begin a suffix).
CACHE, CACHED = 300_000, 64
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that stay one letter each when lower-cased and composed; others might leave a combining mark that joins what follows.
LETTERS = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{400}-\x{45F}]+$"


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, with a bounded memory of words.

    The tokenizer drops white space and never joins across it, so words can be encoded apart. It also
    parts letters from marks and lower-cases, so a word of letters and closing marks has the ids of its
    letters, with A-Z in lower case, then those of its marks. Arrow tells words apart; only those not
    remembered whole are parted, and only what is new among their parts goes to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.whole: dict[str, bytes] = {}

    def _ids(self, words: pa.Array) -> list[bytes]:
        """The ids of each of some words."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        if new := [w for w in distinct if w not in known]:
            for w, e in zip(new, self.model.encode_batch(new, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()
        ids = [known[w] for w in distinct]
        for w in new if len(known) > CACHE else [w for w in new if len(w) > CACHED]:
            del known[w]
        return [ids[i] for i in coded.indices.to_numpy().tolist()]

    def _parted(self, words: pa.Array) -> list[bytes]:
        """The ids of each of some words, from those of their letters and their marks."""
        core = pc.utf8_rtrim(words, MARKS)
        letters = pc.match_substring_regex(core, LETTERS)
        core = pc.if_else(letters, pc.ascii_lower(core), words)
        marks = pc.if_else(letters, pc.replace_substring_regex(words, r"^.*?([" + re.escape(MARKS) + "]*)$", r"\1"), "")
        return [a + b for a, b in zip(self._ids(core), self._ids(marks), strict=True)]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.whole.get, words))
        if new := [i for i, x in enumerate(ids) if x is None]:
            for i, x in zip(new, self._parted(coded.dictionary.take(pa.array(new))), strict=True):
                ids[i] = x
                if len(words[i]) <= CACHED and len(self.whole) < CACHE:
                    self.whole[words[i]] = x
        pool = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        each = sizes[at]
        ends = np.cumsum(each)
        flat = pool[np.repeat(begins[at] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [flat[i:j] for i, j in zip(edges, edges[1:], strict=False)]


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the pieces of every document, cut at length."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)

    last = np.array([end], "<u4").tobytes()

    def make():
        encode = of_worker(tokenizer, lambda: Encoder(tokenizer))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, rows = [], []
            for i, found in enumerate(encode(batch.column(1))):
                ids = found.tobytes() + last
                n = len(ids) // 4
                for start in range(0, n, length):
                    part = ids[4 * start : 4 * (start + length)]
                    at.append(i)
                    rows.append((start, len(part) // 4, zlib.crc32(part), n))
            cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return over_batches(rows, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long", make, keeps=True)


def _price(sizes: np.ndarray, duals: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: the unbounded knapsack over sizes with the duals as values."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for have in range(1, room + 1):
        fits = int(np.searchsorted(sizes, have, "right"))
        best[have], pick[have] = best[have - 1], -2
        if fits:
            worth = best[have - sizes[:fits]] + duals[:fits]
            j = int(worth.argmax())
            if worth[j] > best[have] + 1e-12:
                best[have], pick[have] = worth[j], j
    pattern, have = np.zeros(len(sizes)), room
    while have > 0:
        if pick[have] == -2:
            have -= 1
        else:
            pattern[pick[have]] += 1
            have -= int(sizes[pick[have]])
    return float(best[room]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan elimination with row pivots. (Threaded BLAS can stall in a process that hosts a JVM; nothing here calls it.)"""
    n = len(a)
    both = np.hstack([a, np.eye(n)])
    for i in range(n):
        j = i + int(np.abs(both[i:, i]).argmax())
        both[[i, j]] = both[[j, i]]
        both[i] /= both[i, i]
        rest = both[:, i].copy()
        rest[i] = 0
        both -= rest[:, None] * both[i]
    return both[:, n:]


def solve(demand: dict[int, int], room: int, rounds: int = 4000) -> list[tuple[Counter, int]]:
    """Patterns with their multiplicities that hold exactly the demanded number of pieces of each size."""
    sizes = np.array(sorted(s for s, n in demand.items() if n), int)
    if not len(sizes):
        return []
    want = np.array([demand[s] for s in sizes], float)
    basis = np.diag((room // sizes).astype(float))
    inverse, x = np.diag(1.0 / (room // sizes)), want / (room // sizes)
    for turn in range(1, rounds + 1):
        duals = inverse.sum(axis=0)
        worth, pattern = _price(sizes, duals, room)
        if worth <= 1 + 1e-9:
            break
        move = (inverse * pattern).sum(axis=1)
        if (move <= 1e-11).all():
            break
        ratio = np.where(move > 1e-11, x / np.where(move > 1e-11, move, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        if turn % 200 == 0:
            inverse = _inverse(basis)
            x = (inverse * want).sum(axis=1)
        else:
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
            x = x - move * ratio[out]
            x[out] = ratio[out]
        x = np.maximum(x, 0)
    left = want.astype(int)
    plan: Counter = Counter()
    for j in np.argsort(-x):
        pattern = basis[:, j].astype(int)
        times = min(int(x[j] + 1e-9), *(int(n) // int(a) for n, a in zip(left, pattern, strict=True) if a))
        if times > 0:
            plan[tuple(pattern)] += times
            left -= times * pattern
    bins: list[list[int]] = []
    for i in range(len(sizes) - 1, -1, -1):
        for _ in range(left[i]):
            at = next((b for b in bins if b[0] >= sizes[i]), None)
            if at is None:
                bins.append(at := [room])
            at[0] -= int(sizes[i])
            at.append(i)
    for b in bins:
        plan[tuple(np.bincount(b[1:], minlength=len(sizes)))] += 1
    return [(Counter({int(sizes[i]): int(a) for i, a in enumerate(p) if a}), n) for p, n in plan.items()]


def _shares(plan: list[tuple[Counter, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each size: where each pattern's share of the ranks begins, its first sequence, multiplicity and first slot."""
    shares: dict[int, list] = {}
    seen: Counter = Counter()
    first = 0
    for pattern, times in plan:
        slot = 0
        for size, n in sorted(pattern.items(), reverse=True):
            shares.setdefault(size, []).append((seen[size], first, times, slot))
            seen[size] += n * times
            slot += n
        first += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for s, rows in shares.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, unit: int = UNIT, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece that holds only the end id. Repeated rows are packed as often as
    they come. An empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    n = partitions(spark)
    dealt = cut(
        pieces(docs, tokenizer, length, end)
        .withColumn("size", F.expr(f"cast((length + {unit - 1}) div {unit} as int)"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n)).cast("int"))
    )
    counts = cut(dealt.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")))
    demand = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    shares = _shares(solve(demand, length // unit))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("size").orderBy("salt")) - F.col("n")).drop("n")
    order = W.partitionBy("size", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        dealt.withColumn("rank", F.row_number().over(order) - 1)
        .join(before, ["size", "salt"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", (F.col("rank") + F.col("before")).alias("rank"))
    )

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, ranks = (batch.column(i).to_numpy() for i in (5, 6))
            sequence, slot = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                here = sizes == size
                begin, first, times, at = shares[int(size)]
                j = np.searchsorted(begin, ranks[here], "right") - 1
                past = ranks[here] - begin[j]
                sequence[here], slot[here] = first[j] + past % times[j], at[j] + past // times[j]
            return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(slot)], [*batch.schema.names[:5], "sequence_id", "slot"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = over_batches(ranked, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long", make)
    earlier = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")).drop("slot")


def op1_packing(spark, sf_dir):
    return pack(table(ready(spark), sf_dir, "documents"))
