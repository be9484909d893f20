"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, reporting verb, anything else). Transducers
rewrite the symbols of a clause one after another: reported speech softens what follows a reporting
verb, negation what follows within a few words of a negation, and a target just before an insult or
threat sharpens it. Their composition is one deterministic machine, built once and run over the
clauses that hold an insult or threat; its last tape counts matches by kind. A logistic model,
fitted to labelled rows, turns the weighted counts of a text into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import cut, over_batches, packed, ready, table, unpacked

# The words of the grammar.
INSULTS = "idiot idiots moron morons stupid loser losers scum clown clowns trash pathetic worthless disgusting imbecile dumb dumbass jerk fool bastard bitch asshole shit crap filth filthy vermin freak coward liar garbage ugly retard pig rat dummkopf arschloch idiotisch dumm abschaum wertlos connard imbécile crétin salaud ordure débile idiota estúpido imbécil basura inútil asqueroso cabrón".split()
THREATS = "kill hurt destroy murder shoot stab burn hang beat crush punch strangle umbringen töten tuer frapper matar golpear".split()
TARGETS = "you your you're youre u ur they them he she him her these those du dich dir ihr euch sie tu te toi vous vos ils elle tú ti usted ustedes ellos ella".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't won't nor nicht kein keine nie pas jamais aucun nunca ningún ni".split()
REPORTS = "said says say called calls wrote writes told quoted quote claimed according sagte schrieb nannte laut dit disait écrit selon dijo dice escribió según".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
#: Kinds of match on the machine's last tape.
KINDS = ("insult", "targeted insult", "threat", "targeted threat", "negated", "reported")
#: What a match of each kind weighs before labels say more, and the model's constant for them.
PRIOR, PRIOR_CONSTANT = (2.5, 3.5, 0.5, 2.0, 0.5, 0.5), -3.0
#: Lengths of the word beginnings that labels may show to be insulting.
STEMS = range(4, 9)
WORD, CLAUSE = re.compile(r"[^\W_]+(?:'[^\W_]+)?"), re.compile(r"[.!?;\n]+")

#: A transducer: its start, its states, and step(state, symbol) -> (state, symbol). Symbols past OTHER mark rewritten matches.
Transducer = tuple[int, int, Callable[[int, int], tuple[int, int]]]
MARKED = {"reported": (6, 7), "negated": (8, 9), "targeted": (10, 11)}
SYMBOLS = 12


def _reported(state: int, symbol: int) -> tuple[int, int]:
    if symbol == REPORT:
        return 1, symbol
    return state, MARKED["reported"][symbol] if state and symbol in (INSULT, THREAT) else symbol


def _near(cause: int, mark: str, reach: int) -> Transducer:
    """Marks an insult or threat that comes within reach words of the cause."""

    def step(state: int, symbol: int) -> tuple[int, int]:
        if symbol == cause:
            return reach, symbol
        return max(0, state - 1), MARKED[mark][symbol] if state and symbol in (INSULT, THREAT) else symbol

    return 0, reach + 1, step


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What second makes of what first puts out."""
    (a, n, f), (b, m, g) = first, second

    def step(state: int, symbol: int) -> tuple[int, int]:
        p, middle = f(state // m, symbol)
        q, out = g(state % m, middle)
        return p * m + q, out

    return a * m + b, n * m, step


def machine() -> tuple[list[int], list[int]]:
    """next state and kind (-1: none) at state * 6 + symbol of the composed grammar."""
    start, states, step = compose(compose((0, 2, _reported), _near(NEGATION, "negated", 3)), _near(TARGET, "targeted", 4))
    assert start == 0
    kind = {INSULT: 0, 10: 1, THREAT: 2, 11: 3, 8: 4, 9: 4, 6: 5, 7: 5}
    table = [step(s, x) for s, x in product(range(states), range(6))]
    return [s for s, _ in table], [kind.get(x, -1) for _, x in table]


class Grammar:
    """Match counts of texts under the lexicon; extra stems are insults with whatever ending, and bring their own weights."""

    def __init__(self, extra: dict[str, float]):
        import ahocorasick

        self.symbols = {w: s for s, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, INSULTS)) for w in ws}
        self.stems = extra
        self.find = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w, s in self.symbols.items():
            if s in (INSULT, THREAT):
                self.find.add_word(w)
        for w in extra:
            self.find.add_word(w)
        self.find.make_automaton()
        self.next, self.kind = machine()

    def features(self, text: str) -> list[float]:
        """log(1 + weighted matches) of each kind, and of insults by their share of the words."""
        low = text.lower()
        counts = [0.0] * len(KINDS)
        for end, size in self.find.iter(low):
            at = end - size + 1
            if not low[max(0, at - 1) : at].isalnum() and (not low[end + 1 : end + 2].isalnum() or low[at : end + 1] in self.stems):
                break
        else:
            return [0.0] * (len(KINDS) + 1)
        symbols, stems, next_, kind = self.symbols, self.stems, self.next, self.kind
        words = 0
        for clause in CLAUSE.split(low):
            state, found = 0, WORD.findall(clause)
            words += len(found)
            for w in found:
                symbol, weight = symbols.get(w, OTHER), 1.0
                if stems and symbol in (OTHER, INSULT):
                    weight = max((stems.get(w[:n], 0.0) for n in STEMS), default=0.0)
                    symbol, weight = (INSULT, weight) if weight else (symbol, 1.0)
                at = state * 6 + symbol
                if (k := kind[at]) >= 0:
                    counts[k] += weight
                state = next_[at]
        return [*map(math.log1p, counts), math.log1p(1000 * (counts[0] + counts[1]) / max(words, 1))]


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Penalised logistic regression by Newton steps; the prior's weights where labels of both kinds are too few."""
    if min(y.sum(), (1 - y).sum()) < 10:
        return np.array([*PRIOR, 0.0]), PRIOR_CONSTANT
    a = np.hstack([x, np.ones((len(x), 1))])
    prior = np.array([*PRIOR, 0.0, 0.0])
    ridge = np.diag([0.5] * x.shape[1] + [1e-6])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip((a * w).sum(axis=1), -30, 30)))
        bend = np.einsum("ni,nj,n->ij", a, a, p * (1 - p) + 1e-9, optimize=False) + ridge
        step = np.linalg.solve(bend, (a * (p - y)[:, None]).sum(axis=0) + np.diag(ridge) * (w - prior))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _featured(docs: DataFrame, extra: dict[str, float], schema: StructType, finish) -> DataFrame:
    """docs' other columns, and what finish makes of the feature matrix of their texts; text comes last."""

    def make():
        grammar = Grammar(extra)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([grammar.features(t) for t in batch.column(batch.num_columns - 1).to_pylist()])
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], *finish(found)], names)

        return each

    names = schema.names
    return over_batches(docs, schema, make)


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = 12_000, words: int = 300) -> tuple[dict[str, float], np.ndarray, float]:
    """Insulting stems with their weights, and the model; from at most rows labelled documents, those first by hash, none held out."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~_held_out())
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(rows)
    )
    sample = cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: Counter = Counter()
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set(WORD.findall(text.lower()))
                seen.update({(w[:n], toxic) for w in found for n in STEMS if len(w) >= n})
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "toxic", "n"])

        return each

    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    lift = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    counted = (
        over_batches(sample, "word string, toxic int, n long", make)
        .groupBy("word")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
        .where(F.col("bad") >= max(5, bad // 100))
        .select("word", lift.alias("lift"), "bad")
        .where("lift > 2")
        .orderBy(F.desc("bad"), F.desc("lift"), "word")
        .limit(words)
    )
    extra = {r["word"]: min(3.0, r["lift"] / 2) for r in counted.collect()} if min(bad, good) >= 10 else {}
    names = [f"f{i}" for i in range(len(KINDS) + 1)]
    found = _featured(sample, extra, StructType.fromDDL("toxic int, " + ", ".join(f"{n} double" for n in names)), lambda m: [pa.array(np.ascontiguousarray(c)) for c in m.T]).toPandas()
    weights, constant = _fit(found[names].to_numpy(float), found["toxic"].to_numpy(float))
    return extra, weights, constant


def score(docs: DataFrame, labels: DataFrame, rows: int = 12_000) -> DataFrame:
    """(doc_id, score): the probability of label 1 of every whole text; null and empty texts get that of no match.

    The score reads the text alone, of any length. Labels that are null, or of documents not in docs, are passed over; with
    fewer than ten labels of a kind the grammar's own weights hold. Equal texts have equal scores, and repeated rows are each answered.
    An empty table gives no rows; other columns are passed over.
    """
    ready(docs.sparkSession)
    extra, weights, constant = learn(docs, labels, rows)

    def probability(m: np.ndarray) -> list[pa.Array]:
        return [pa.array(1 / (1 + np.exp(-np.clip((m * weights).sum(axis=1) + constant, -30, 30))))]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _featured(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), extra, StructType.fromDDL(f"doc_id {kind}, score double"), probability)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores below threshold, with all their columns, scored in place; null texts and repeated rows as in score."""
    ready(docs.sparkSession)
    extra, weights, constant = learn(docs, labels)

    def below(m: np.ndarray) -> list[pa.Array]:
        return [pa.array((m * weights).sum(axis=1) + constant < math.log(threshold / (1 - threshold)))]

    rows = packed(docs).select("row", "text")
    kept = _featured(rows, extra, StructType([rows.schema["row"], StructField("clean", BooleanType())]), below)
    return unpacked(kept.where("clean"), docs.columns)


def op2_toxicity(spark, sf_dir):
    """Each document's score and whether it is called toxic. Null and empty texts score as texts without a match; a null doc_id is not held
    out; equal texts score alike; repeated rows are each answered; an empty table gives no rows."""
    docs, labels = (table(ready(spark), sf_dir, t) for t in ("documents", "labels"))
    scored = score(docs, labels)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
