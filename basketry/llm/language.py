"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes with the counts of what followed,
taken from a bounded sample of labelled texts (see sample) and frozen. A byte's probability comes from the longest
context that the language has seen; a byte new there escapes, with the probability q / (n + q) that n
occurrences of q different bytes give, to the next shorter context, without the bytes already ruled out
(method C with exclusion), down to equal chances. What a byte costs after it escaped from a context is what it costs
in the shorter one and an amount that the context alone decides, so only what was seen is tabulated, and a text's exact
length is a sum of look-ups. The language with the shortest code wins.

The model holds every run of four bytes of the sample, whose bytes are bounded (BYTES), and for each the
bits of every language: 4 * languages + 8 bytes a run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, over_batches, raw_text, ready, small, table

ORDER, SPACE = 3, 32
#: Labelled rows of a language that it is learned from at most, bytes of texts of all languages together, bytes of a text that are taken in any
#: case, and languages whose counts are broadcast.
ROWS, BYTES, LEAST_BYTES, LANGUAGES = 1000, 16 << 20, 256, 100_000
#: Bytes scored at a time.
CHUNK = 1 << 18
LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])


def _laid_out(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjoining texts (text i ends before ends[i]) with ORDER spaces before each, and each byte's place there."""
    sizes = np.diff(ends, prepend=0)
    at = np.arange(len(values)) + np.repeat(ORDER * (1 + np.arange(len(ends))), sizes)
    line = np.full(len(values) + ORDER * len(ends), SPACE, np.int64)
    line[at] = values
    return line, at


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes in one piece, and where each value ends in it."""
    wide = 8 if pa.types.is_large_binary(column.type) else 4
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide == 8 else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return values, offsets[1:] - offsets[0]


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key among sorted keys, -1 where it is not there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Model:
    """The bits of every byte after every context, for all languages at once.

    bits[o]: by run of o + 1 bytes (runs[o], sorted), what its last byte costs after the others. escapes[o]: by context of o
    bytes (contexts[o], sorted), what it costs to leave it for the shorter one, 0 where the language has not seen it.
    """

    def __init__(self, languages: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray):
        """How often (n) each run of four bytes (code, read as a number) occurs in the texts of languages[lang]."""
        self.languages = languages
        self.runs, self.bits, self.contexts, self.escapes = [], [], [], []
        count = len(languages)
        if not count:
            return
        for order in range(ORDER + 1):
            runs, at = np.unique(code & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            seen = np.zeros((len(runs), count))
            np.add.at(seen, (at, lang), n)
            contexts, of = np.unique(runs >> 8, return_inverse=True)
            starts = np.nonzero(np.diff(of, prepend=-1))[0]
            whole, kinds = np.add.reduceat(seen, starts), np.add.reduceat((seen > 0).astype(float), starts)
            shorter = self._costs(order - 1, runs & ((1 << 8 * order) - 1)) if order else np.full((len(runs), count), 8.0)
            # What the shorter context leaves to bytes that this one has not seen.
            rest = 1 - np.add.reduceat(np.where(seen > 0, np.exp2(-shorter), 0), starts)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(whole > 0, np.log2((whole + kinds) / kinds) + np.log2(np.maximum(rest, 1e-12)), 0)
                own = np.log2(np.repeat(whole + kinds, np.diff([*starts, len(runs)]), axis=0) / seen)
            self.runs.append(runs)
            self.contexts.append(contexts)
            self.escapes.append(escape)
            self.bits.append(np.where(seen > 0, own, escape[of] + shorter))
        self.bits = [b.astype(np.float32) for b in self.bits]
        self.escapes = [e.astype(np.float32) for e in self.escapes]

    def _costs(self, order: int, runs: np.ndarray) -> np.ndarray:
        """What the last byte of each run of order + 1 bytes costs after the others, in every language."""
        if order < 0:
            return np.full((len(runs), len(self.languages)), 8.0, np.float32)
        at = _find(self.runs[order], runs)
        out = self.bits[order][at]
        new = np.nonzero(at < 0)[0]
        if len(new):
            shorter = self._costs(order - 1, runs[new] & ((1 << 8 * order) - 1))
            context = _find(self.contexts[order], runs[new] >> 8)
            out[new] = shorter + np.where(context[:, None] >= 0, self.escapes[order][context], 0)
        return out

    def lengths(self, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(ends), len(self.languages)))
        line, at = _laid_out(values, ends)
        owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        for lo in range(0, len(at), CHUNK):
            here = at[lo : lo + CHUNK]
            runs = line[here - 3] << 24 | line[here - 2] << 16 | line[here - 1] << 8 | line[here]
            # A run that occurs often is looked up once.
            runs, of = np.unique(runs, return_inverse=True)
            cost = self._costs(ORDER, runs)[of]
            docs = owner[lo : lo + CHUNK]
            starts = np.nonzero(np.diff(docs, prepend=-1))[0]
            out[docs[starts]] += np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        return out


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """(lang, b): what the model is learned from, of documents that have a lang and are not held out.

    Of each language at most rows texts, the first by hash. Languages share size bytes evenly, and so do a language's texts, which may
    have LEAST_BYTES in any case; of a longer text a stretch is taken that begins at a place drawn by hash. So no text, however long, leaves another
    one or a language out, and a rare language is learned from as much as it has.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).where(~_held_out())
    usable = usable.select("doc_id", "lang", (F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))).alias("hash"), raw_text().alias("b"))
    known = cut(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("least")))
    each = F.floor(F.lit(size // max(1, known.count())) / F.least(F.lit(rows), F.col("n"))).cast("int")
    # Of a common language only hashes in the least part of their range can be among the first; some four times as many rows as wanted lie there.
    near = usable.join(small(known, LANGUAGES), "lang").where((F.col("hash") * F.col("n") < 4.0 * rows) | (F.col("hash") == F.col("least")))
    near = near.withColumn("most", F.greatest(F.lit(LEAST_BYTES), each))
    begin = F.pmod(F.xxhash64("doc_id", "lang"), F.greatest(F.lit(1), F.octet_length("b") - F.col("most") + 1)).cast("int")
    near = near.withColumn("begin", begin + 1).select("lang", "hash", "doc_id", F.expr("substring(b, begin, most)").alias("b"))
    order = Window.partitionBy("lang").orderBy("hash", "doc_id", "b")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows).select("lang", "b")


def learn(docs: DataFrame, rows: int = ROWS, size: int = BYTES) -> Model:
    """The model of the sample of documents."""
    some = cut(sample(docs, rows, size))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            values, ends = _bytes_of(batch.column(1))
            line, at = _laid_out(values, ends)
            runs = line[at - 3] << 24 | line[at - 2] << 16 | line[at - 1] << 8 | line[at]
            owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            names = batch.column(0).dictionary_encode()
            of = names.indices.to_numpy().astype(np.int64)[owner] if len(owner) else owner
            keys, n = np.unique(of << 32 | runs, return_counts=True)
            return pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(keys >> 32)), pa.array(keys & 0xFFFFFFFF), pa.array(n)], ["lang", "code", "n"])

        return each

    counted = over_batches(some, "lang string, code long, n long", make).groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(counted["lang"].unique().to_pylist())
    lang = np.searchsorted(np.array(names, object), counted["lang"].to_numpy()) if names else np.empty(0, int)
    return Model(names, lang, counted["code"].to_numpy(), counted["n"].to_numpy())


def identify(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text: the language of the shortest code and its share of the probability.

    "und" with score 0 where the text is null or has no letter, or no language could be learned.
    Equal lengths go to the first language by name. The text alone decides. Texts of any length are read whole; repeated rows are
    each answered; an empty table gives no rows; other columns are passed over.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(learn(docs, rows))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            model = shared.value
            values, ends = _bytes_of(batch.column(1))
            starts = ends - np.diff(ends, prepend=0)
            letters = np.concatenate([[0], np.cumsum(LETTER[values])])
            has = letters[ends] > letters[starts]
            for i in np.nonzero(~has & (ends > starts))[0]:
                has[i] = any(map(str.isalpha, values[starts[i] : ends[i]].tobytes().decode("utf-8", "replace")))
            if not model.languages:
                has[:] = False
                bits = np.zeros((len(ends), 1))
            else:
                bits = model.lengths(values, ends)
            best = bits.argmin(axis=1)
            odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000))
            names = [model.languages[j] if ok else "und" for j, ok in zip(best, has, strict=True)]
            score = np.where(has, 1 / odds.sum(axis=1), 0.0)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_batches(docs.select("doc_id", raw_text().alias("b")), f"doc_id {kind}, lang_pred string, score double", make)


def op10_language(spark, sf_dir):
    """Each document's language. Null texts and those without a letter are "und"; equal lengths go to the first language by name; a null
    doc_id is not held out; repeated rows are each answered; an empty table gives no rows."""
    return identify(table(ready(spark), sf_dir, "documents")).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")
