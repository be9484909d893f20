"""Operators against brute-force versions, exact round trips and held-out labels, on the smallest tables and random inputs."""

import functools
import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.llm import decontaminate, exact_dedup, html_extract, language, line_dedup, packing, registry, simhash, substring_dedup, toxicity
from basketry.llm.graph import components

from ..oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, tmp_path, name):
    assert differences(connect(SF), registry.queries()[name](spark, SF), registry.oracle_sql()[name], str(tmp_path / "out")) == (0, 0)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), min_size=1))
@settings(max_examples=40, deadline=None)
def test_plans_hold_the_demand(demand):
    plan = packing.solve(demand, 40)
    got = Counter()
    for pattern, times in plan:
        assert times > 0 and sum(s * n for s, n in pattern.items()) <= 40
        got.update({s: n * times for s, n in pattern.items()})
    assert got == Counter(demand)
    bins: list = []
    for size in sorted((s for s, n in demand.items() for _ in range(n)), reverse=True):
        at = next((i for i, room in enumerate(bins) if room >= size), None)
        if at is None:
            bins.append(40)
            at = -1
        bins[at] -= size
    assert sum(n for _, n in plan) <= 1.02 * len(bins) + 2


def test_packing_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    model.encode_special_tokens = True
    rows = packing.pack(docs).toPandas()
    for doc, part in rows.groupby("doc_id"):
        ids = np.array([*model.encode(texts[doc], add_special_tokens=False).ids, 2], "<u4")
        part = part.sort_values("start")
        assert part["start"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() == len(ids) == part["doc_tokens"].iloc[0]
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in part.itertuples())
    order = rows.sort_values(["sequence_id", "offset"])
    assert (order.groupby("sequence_id")["length"].cumsum() - order["length"] == order["offset"]).all() and order.groupby("sequence_id")["length"].sum().max() <= 4096
    assert rows["length"].sum() > 0.9 * 4096 * rows["sequence_id"].nunique()


@given(st.lists(st.text(alphabet="aZéÉßİΣ ,.'!?_1\n\t*́-<|>", max_size=40), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_words_are_encoded_apart(some):
    encode = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    got = encode(pa.array(some))
    assert [g.tolist() for g in got] == [e.ids for e in encode.model.encode_batch(some, add_special_tokens=False)]


def brute_fingerprint(text: str, shingle: int) -> int:
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(keys: list, near) -> dict:
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash(docs, texts):
    fps = {d: brute_fingerprint(t, 3) for d, t in texts.items()}
    want = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    rows = simhash.near_groups(docs).collect()
    assert {(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows} == {(d, fps[d], want[d]) for d in fps}


@pytest.mark.parametrize(("k", "node"), [(0, 1000), (1, 1000), (2, 1000), (1, 3), (2, 3)])
def test_links_of_dense_fingerprints(spark, k, node):
    rng = random.Random(k)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(14)})
    rows = spark.createDataFrame([(0, f - 2**64 if f >= 2**63 else f) for f in fps], "seed int, id long").selectExpr("seed", "id", "id AS fp")
    import basketry.llm.simhash as module

    got = components(module.links(rows, k, None, node))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    want = brute_components(sorted(signed), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= k)
    sizes = Counter(want.values())
    assert {r["node"]: r["root"] for r in got.collect()} == {n: r for n, r in want.items() if sizes[r] > 1}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100)}


def test_near_copies(spark):
    rng = random.Random(5)
    words = ["w" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(900)]
    clean = [" ".join(rng.choices(words, k=300)) for _ in range(30)]
    near = [" ".join(w if i % 97 else "changed" for i, w in enumerate(t.split(), 1)) for t in clean[:10]]
    shuffled = [" ".join(rng.sample(t.split(), 300)) for t in clean[10:20]]
    df = spark.createDataFrame(list(enumerate(clean + near + shuffled)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(df).collect()) == [*range(30), *range(40, 50)]


def test_many_texts_of_one_vocabulary_stay(spark):
    rng = random.Random(3)
    words = ["w" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(rng.sample(words, 60))) for i in range(1500)], "doc_id long, text string")
    assert simhash.drop_near_copies(df).count() == 1500


def test_near_copies_of_every_kind_of_edit(spark):
    rng = random.Random(11)
    words = ["w" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(5000)]
    texts, near = [], []
    for n in (10, 60, 200, 1000):
        for extra in (n // 10, n // 5, n // 3):
            for _ in range(6):
                t = rng.sample(words, n)
                new = [f"new{rng.random()}" for _ in range(extra)]
                at = rng.randrange(n)
                near += [(len(texts), len(texts) + i) for i in range(1, 5)]
                texts += [t, t + new, t[: n - extra], t[:at] + new + t[at:], [f"x{i}" if i % 40 == 7 else w for i, w in enumerate(t)]]
    grams = [set(zip(*(t[i:] for i in range(5)), strict=False)) for t in texts]
    wanted = brute_components(list(range(len(texts))), lambda a, b: 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b]))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(df).collect()) == sorted(set(wanted.values()))


@functools.cache
def grams(text: str) -> frozenset:
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(a: str, b: str) -> float:
    both = len(grams(a) & grams(b))
    return both / (len(grams(a)) + len(grams(b)) - both)


@pytest.mark.parametrize("block", [1 << 23, 3000])
def test_groups_of_a_cluster_in_blocks(spark, block):
    """Edited copies of three texts, from above to below the similarity, so that groups hang together by some pairs only."""
    rng = random.Random(block)
    texts = {}
    for base in range(3):
        words = [f"b{base}w{i}" for i in range(60)]
        for _ in range(60):
            texts[len(texts)] = " ".join(w if rng.random() > 0.025 else f"n{rng.random()}" for w in words[: rng.randrange(50, 61)])
    texts |= {500: "Short One", 501: "short one", 502: "short", 503: "", 504: " \n"}
    want = brute_components(sorted(texts), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    df = spark.createDataFrame(sorted(texts.items()), "id long, text string")
    got = {r["id"]: r["root"] for r in simhash.near_copies(df, block).collect()}
    groups = lambda of: sorted(tuple(sorted(k for k in of if of[k] == r)) for r in set(of.values()))
    assert 20 < len(set(want.values())) < 150
    assert groups({i: got.get(i, i) for i in texts}) == groups(want)


def test_near_copies_of_all_documents(spark, texts):
    """Every pair of the smallest table's texts that comes near 0.8, counted one by one."""
    once = sorted({t: d for d, t in sorted(texts.items(), reverse=True)}.values())
    want = brute_components(once, lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    df = spark.createDataFrame([(d, texts[d]) for d in texts], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(df).collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("block", [7, 8192])
def test_block_names(docs, texts, block):
    groups = defaultdict(list)
    for d, t in texts.items():
        groups[t].append(d)
    want = {(d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
    few = docs if block > 100 else docs.limit(60)
    got = {tuple(r) for r in exact_dedup.exact_groups(few, block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    if block > 100:
        assert got == want
    else:
        ids = {r[0] for r in got}
        assert len(got) == 60 and all(r[1] == max(i for i in groups[texts[r[0]]] if i in ids) for r in got)


def test_blocks_that_share_a_digest(spark, monkeypatch):
    import basketry.llm.exact_dedup as module

    monkeypatch.setattr(module.F, "md5", lambda c: module.F.lit("00"))
    monkeypatch.setattr(module.F, "length", lambda c: module.F.lit(1))
    df = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "aa"), (4, "b")], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"]) for r in module.exact_groups(df, 1).collect()}
    assert got == {(1, 3), (2, 2), (3, 3), (4, 4)}


def brute_repeats(texts: dict) -> set:
    first: dict = {}
    words = {d: t.encode().split() for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), d)
    want = set()
    for d, w in words.items():
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        want.add((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return want


@pytest.mark.parametrize("held", [40_000, 60, 1])
def test_repeats(docs, texts, held):
    assert {tuple(r) for r in substring_dedup.drop_repeats(docs, held).collect()} == brute_repeats(texts)


@pytest.mark.parametrize("held", [40_000, 300, 1])
def test_repeats_of_few_words(spark, held):
    rng = random.Random(held)
    base = [rng.choice("abc") for _ in range(400)]
    texts = {i: " ".join(rng.choice("ab") if rng.random() < 0.02 else w for w in base[rng.randrange(200) :]) for i in range(25)}
    texts |= {30: "alpha beta gamma delta " * 300, 31: "beta gamma delta alpha " * 200, 32: "\u3000x \x1cy\tz" * 60, 33: "\u3000x \x1cy\tz" * 60 + " end"}
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert {tuple(r) for r in substring_dedup.drop_repeats(df, held).collect()} == brute_repeats(texts)


@given(st.lists(st.sampled_from(["a", "b"]), max_size=160))
@settings(max_examples=60, deadline=None)
def test_equal_windows_have_equal_prefixes(words):
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    names, at = substring_dedup.prefixes(hashes)
    assert len(names) == max(0, len(words) - 49)
    longer = substring_dedup.longer_prefixes(hashes, at) if len(names) else names
    seen: dict = {}
    for i, n in enumerate(zip(names.tolist(), longer.tolist(), (at - np.arange(len(at))).tolist(), strict=True)):
        assert seen.setdefault(tuple(words[i : i + 50]), n) == n


@given(st.lists(st.tuples(st.integers(0, 5), st.lists(st.integers(0, 1), min_size=52, max_size=52)), min_size=1, max_size=12), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_nodes_of_a_tree(rows, same):
    rows = sorted(((d, [0] * (49 - same) + w[: 3 + same]) for d, w in rows), key=lambda r: r[1])
    depth = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))
    common = [0, *(depth(a, b) for (_, a), (_, b) in zip(rows, rows[1:], strict=False))]
    got = substring_dedup._nodes(np.array([d for d, _ in rows]), np.array(common))
    for (d, w), covered in zip(rows, got.tolist(), strict=True):
        most = max((depth(w, v) for e, v in rows if e < d), default=0)
        assert covered == (most if most >= 50 else 0)


def test_retrieval(spark, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.Index(items)
    step = index.length // 2
    for text in list(texts.values())[:80] + [t for _, t in items]:
        found = decontaminate.words(text)
        ids = np.fromiter((index.terms.get(w, -1) for w in found), np.int64, len(found))
        slow = set()
        for p in range(max(0, -(-(len(ids) - index.length) // step)) + 1):
            scores: Counter = Counter()
            for j in set(ids[p * step : p * step + index.length].tolist()) - {-1}:
                for k in range(index.first[j], index.first[j + 1]):
                    scores[int(index.item[k])] += index.impact[k]
            slow |= {(p, i) for i, s in scores.items() if s >= index.threshold[i] - 1e-9}
        assert {(p, i) for p, i, _ in index.retrieve(ids)} == slow
    assert all(i in {m[0] for m in index.matches("x " * 70 + t.upper() + " y" * 90)} for i, t in items)


def test_item_blocks_change_nothing(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(tuple(r) for r in decontaminate.leaks(docs, items).collect())
    assert whole and sorted(tuple(r) for r in decontaminate.leaks(docs, items, 5).collect()) == whole
    kept = lambda size: sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs, items, size).collect())
    assert kept(5) == kept(1000) == sorted(set(r["doc_id"] for r in docs.collect()) - {r[0] for r in whole})


def test_leaks_are_those_of_the_definition(spark, docs, texts):
    """Every passage of every document against every item, scored and verified one by one."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bags = {i: decontaminate.words(t) for i, t in items}
    df = Counter(t for w in bags.values() for t in set(w))
    mean, length = sum(map(len, bags.values())) / len(bags), max(32, 2 * max(map(len, bags.values())))
    k, b = decontaminate.K1, decontaminate.B
    impact = {i: {t: math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * f * (k + 1) / (f + k * (1 - b + b * len(w) / mean)) for t, f in Counter(w).items()} for i, w in bags.items()}
    want = []
    for d, text in texts.items():
        found = decontaminate.words(text)
        passages = [found[s : s + length] for s in range(0, max(1, len(found) - length // 2), length // 2)] if found else []
        passages = passages[: max(0, -(-(len(found) - length) // (length // 2))) + 1]
        for i, t in items:
            question, answer = map(decontaminate.runs, decontaminate.split_item(t))
            best = None
            for p, passage in enumerate(passages):
                score = sum(impact[i][x] for x in set(passage) & set(impact[i]))
                if score < decontaminate.SHARE * sum(impact[i].values()) - 1e-9:
                    continue
                shares = [len(x & decontaminate.runs(passage, len(next(iter(x))))) / len(x) if x else 1.0 for x in (question, answer)]
                if min(shares) >= decontaminate.FOUND and (best is None or score > best[1] + 1e-9):
                    best = (p * (length // 2), score, *shares)
            if best:
                want.append((d, i, *best))
    got = sorted(tuple(r) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and len(got) >= 3
    assert all(a[3:] == pytest.approx(b[3:]) for a, b in zip(got, sorted(want), strict=True))


def test_leaks_are_those_that_hold_items(spark, docs, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} <= got


def ppm_bits(texts: list[bytes], text: bytes) -> float:
    """Code length by the definition: longest known context first, escapes with exclusion."""
    tree: dict = defaultdict(Counter)
    for t in texts:
        line = b"   " + t
        for i in range(3, len(line)):
            for order in range(4):
                tree[line[i - order : i]][line[i]] += 1
    line, bits = b"   " + text, 0.0
    for i in range(3, len(line)):
        out: set = set()
        for order in (3, 2, 1, 0):
            counts = tree.get(line[i - order : i])
            if not counts:
                continue
            n, q = sum(counts.values()), len(counts)
            # Probabilities under this context alone, every byte not ruled out by a longer one.
            chances = ppm_chances(tree, line[i - order : i])
            left = sum(p for b, p in enumerate(chances) if b not in out)
            if line[i] in counts:
                bits -= math.log2(counts[line[i]] / (n + q) / left)
                break
            bits -= math.log2(sum(p for b, p in enumerate(chances) if b not in counts and b not in out) / left)
            out |= set(counts)
        else:
            bits += math.log2(256 - len(out))
    return bits


def ppm_chances(tree: dict, context: bytes) -> list[float]:
    """The probability of every byte after a context: seen ones by count, the escape shared out as the shorter context has it."""
    shorter = ppm_chances(tree, context[1:]) if context else [1 / 256] * 256
    counts = tree.get(context)
    if not counts:
        return shorter
    n, q = sum(counts.values()), len(counts)
    rest = sum(p for b, p in enumerate(shorter) if b not in counts)
    return [counts[b] / (n + q) if b in counts else q / (n + q) * p / rest for b, p in enumerate(shorter)]


def test_code_lengths_are_exact():
    rng = random.Random(1)
    texts = {"aa": ["".join(rng.choices("abcabé ", k=200)) for _ in range(4)], "bb": ["".join(rng.choices("bcdde E1", k=150)) for _ in range(3)], "cc": ["x"]}
    rows = []
    for i, (_, some) in enumerate(sorted(texts.items())):
        for t in some:
            line = b"   " + t.encode()
            rows += [(i, int.from_bytes(line[j - 3 : j + 1], "big"), 1) for j in range(3, len(line))]
    model = language.Model(sorted(texts), *map(np.array, zip(*rows, strict=True)))
    for text in ("abc cab", "dede zq", "", "abé", "E1 E1 xx", "\u4f60"):
        values = np.frombuffer(text.encode(), np.uint8)
        got = model.lengths(values, np.array([len(values)]))[0]
        for j, lang in enumerate(model.languages):
            assert got[j] == pytest.approx(ppm_bits([t.encode() for t in texts[lang]], text.encode()), rel=1e-4, abs=1e-3)


def test_a_rare_language_is_learned(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("aeiou tn", k=80)), "common") for i in range(300)] + [(900 + i, "".join(rng.choices("xyzwq k", k=80)), "rare") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, 50).collect()}
    assert all(got[d] == lang for d, _, lang in rows)


def test_languages_of_held_out_documents(spark):
    rows = language.op10_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows) > 0


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert sum(b > g for b in bad for g in good) > 0.85 * len(bad) * len(good)


@given(st.lists(st.integers(0, 5), max_size=25))
@settings(max_examples=200, deadline=None)
def test_the_composed_machine_is_its_transducers_in_turn(symbols):
    """Each transducer rewrites the whole tape of the one before; what is left of insults and threats is what the machine counts."""
    tape = list(symbols)
    for start, _, step in ((0, 2, toxicity._reported), toxicity._near(toxicity.NEGATION, "negated", 3), toxicity._near(toxicity.TARGET, "targeted", 4)):
        state, written = start, []
        for x in tape:
            state, y = step(state, x)
            written.append(y)
        tape = written
    of = {toxicity.INSULT: "insult", toxicity.THREAT: "threat"} | {y: name for name, pair in toxicity.MARKED.items() for y in pair}
    want = [of.get(x) and (of[x] if of[x] != "targeted" else f"targeted {'insult' if x == toxicity.MARKED['targeted'][0] else 'threat'}") for x in tape]
    follow, kind = toxicity.machine()
    state, got = 0, []
    for x in symbols:
        k = kind[state * 6 + x]
        got.append(toxicity.KINDS[k] if k >= 0 else None)
        state = follow[state * 6 + x]
    assert got == want


def test_clauses_decide_where_labels_say_so(spark):
    """The same insults in every text; only the clause around them tells toxic ones from others."""
    rng = random.Random(9)
    insults = ["moron", "idiot", "clown", "loser"]
    forms = [("you are such a {}", 1), ("this was never a {}", 0), ("anna said the {} left", 0), ("you stupid {}", 1)]
    rows = []
    for i in range(400):
        form, toxic = forms[i % 4]
        rows.append((i, f"some words {rng.randrange(99)}. {form.format(rng.choice(insults))}. and more", toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    assert all((scores[i] >= 0.3) == bool(toxic) for i, _, toxic in rows)


def test_toxicity_by_language(spark):
    sf = "/root/testdata/sf0.1"
    labels, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "documents"))
    rows = toxicity.op2_toxicity(spark, sf).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    for lang in ("en", "de", "fr", "es"):
        bad, good = ([r["predicted"] for r in rows if r["lang"] == lang and r["toxic"] == y] for y in (1, 0))
        assert sum(bad) >= 0.8 * len(bad) > 0 and sum(good) <= 0.05 * len(good)


def test_clause_grammar():
    grammar = toxicity.Grammar({"zorp": 2.0})
    kinds = lambda t: {k for k, c in zip((*toxicity.KINDS, "share"), grammar.features(t), strict=True) if c and k != "share"}
    assert kinds("The moron left.") == {"insult"}
    assert kinds("You are a moron.") == {"targeted insult"}
    assert kinds("He is not a moron.") <= {"negated", "targeted insult"}
    assert kinds("This is never a moron.") == {"negated"}
    assert kinds("She said what a moron.") <= {"reported", "targeted insult"} and "reported" in kinds("They reported: Anna said moron")
    assert kinds("I will kill you. You die") == {"threat"} and kinds("you I kill") == {"targeted threat"}
    assert kinds("oxymoronic morons2 amoron") == set() and kinds("zorpification") == {"insult"}


def test_line_templates(spark, docs):
    stock = [(i, f"alpha beta gamma number {i} of the user{i} list shared here\nown words {'x' * (i + 1)} only {i}") for i in range(12)]
    df = spark.createDataFrame([*stock, (99, "alpha beta gamma but wholly other words than the rest here"), (100, "quiet\n\nquiet")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.clean_lines(df).collect()}
    assert all(got[i]["text"].startswith("own words") and got[i]["n_dropped"] == 1 for i in range(12))
    assert got[99]["n_dropped"] == 0 and got[100]["text"] == "quiet\n\nquiet" and got[100]["n_lines"] == 2


def brute_lines(docs: list[tuple], min_docs: int, constant: float = line_dedup.CONSTANT) -> dict:
    """Numbers of the dropped lines of each document, by the definition: every path of every line, every level of constants."""
    lines = [(d, i, x.strip(" ")) for d, t in docs for i, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    having = defaultdict(set)
    for d, _, x in lines:
        having[x].add(d)
    leaves = defaultdict(set)
    for x in having:
        tokens = x.split(" ")
        plain = ["<*>" if re.search("[0-9]", t) else t for t in tokens]
        for later, s in enumerate((0, min(3, len(tokens) - 3))):
            if len(tokens) > 3:
                leaves[(len(tokens), later, *plain[s : s + 3])].add(x)
    gone = {x for x, ds in having.items() if len(ds) >= min_docs}
    for leaf, members in leaves.items():
        weight = Counter()
        for x in members:
            for place in enumerate(x.split(" ")):
                weight[place] += len(having[x])
        found = defaultdict(set)
        for x in members:
            tokens = sorted(((weight[p], p) for p in enumerate(x.split(" ")) if weight[p] >= min_docs), reverse=True)
            least = max(1, math.ceil(constant * leaf[0] - 1e-9))
            for level in {w for w, _ in tokens[least - 1 :]}:
                found[frozenset(p for w, p in tokens if w >= level)].add(x)
        for same in found.values():
            if len(set().union(*(having[x] for x in same))) >= min_docs:
                gone |= same
    out = defaultdict(set)
    for d, i, x in lines:
        if x in gone:
            out[d].add(i)
    return out


@pytest.mark.parametrize(("min_docs", "small"), [(3, 300_000), (10, 0)])
def test_lines_are_those_of_the_definition(spark, docs, min_docs, small, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    rng = random.Random(min_docs)
    forms = ["{} has joined the group chat now", "error {} in module {} at line {}", "{} {} {}", "{}", "total {} of the day is {} units sold", "see you at {} on the old {} bridge", "{} and {} went home to rest early today"]
    word = lambda: rng.choice([str(rng.randrange(50)), rng.choice("anna bert carl dora".split()), f"x{rng.randrange(9)}"])
    rows = [(i, "\n".join(rng.choice(forms).format(word(), word(), word()) for _ in range(rng.randrange(6)))) for i in range(60)]
    rows += [(100 + r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_lines(rows, min_docs)
    got = {r["doc_id"]: r for r in line_dedup.clean_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs).collect()}
    assert sum(map(len, want.values())) > 30
    for d, t in rows:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d])
        assert (got[d]["text"], got[d]["n_dropped"]) == (kept, len(want[d])), d


def test_numbers_and_leading_fields(spark):
    numbers = [(i, f"{1000 + 37 * i}\n{i}.5 {2 * i + 1} {7 * i}\n{i} {i * i} {i + 3} {i - 4} {5 * i}") for i in range(12)]
    got = line_dedup.clean_lines(spark.createDataFrame(numbers, "doc_id long, text string")).collect()
    assert {r["n_dropped"] for r in got} == {0}
    names = "anna berta carla dora emma frida greta hanna ines jana klara lena".split()
    first = spark.createDataFrame([(i, f"{n} has joined the group\n{n} {names[i - 3]} has left the large group chat") for i, n in enumerate(names)], "doc_id long, text string")
    assert {r["n_dropped"] for r in line_dedup.clean_lines(first).collect()} == {2}


def test_variable_words_are_generalised(spark):
    names = "anna berta carla dora emma frida greta hanna ines jana klara lena".split()
    df = spark.createDataFrame([(i, f"please send your letter to {n} at our office before noon today") for i, n in enumerate(names)], "doc_id long, text string")
    assert {r["n_dropped"] for r in line_dedup.clean_lines(df).collect()} == {1}
    assert {r["n_dropped"] for r in line_dedup.clean_lines(df, min_docs=13).collect()} == {0}


def test_wrapper_drops_constants_without_article():
    page = "<body><div class=top><p>Welcome to the site</p></div><div class=main><p>{}</p><p>{}</p></div><p>All rights kept</p></body>"
    wrapper = None
    for i in range(4):
        wrapper = html_extract.join_wrappers(wrapper, html_extract.wrapper_of(html_extract.parse(page.format(f"first {i}", f"second {i}"))))
    assert html_extract.extract(page.format("x", "y"), wrapper) == "x\n\ny"
    assert html_extract.extract(page.format("x", "y")) == "Welcome to the site\n\nx\n\ny\n\nAll rights kept"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div><p>By <b>Ann</b> unique text {}</p></div>", "unique text 9"),
        ("<div><p>Welcome</p><h2>{}</h2><p>unique body {}</p></div>", "9\n\nunique body 9"),
        ("<div><p>Welcome</p><h2>Title</h2><p>{}</p></div>", "9"),
    ],
)
def test_texts_are_aligned_with_the_wrapper(page, want):
    wrapper = None
    for i in range(4):
        wrapper = html_extract.join_wrappers(wrapper, html_extract.wrapper_of(html_extract.parse(page.format(i, i))))
    assert html_extract.extract(page.format(9, 9), wrapper) == want
    changed = page.format(9, 9).replace("Welcome", "Goodbye").replace("By ", "Of ")
    assert html_extract.extract(changed, wrapper).startswith(("Goodbye", "Of"))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h1>A</h1><p>b <b>c</b><br>d<p>e<ul><li>f<li>g</ul></article><footer>x</footer>", "A\n\nb c d\n\ne\n\nf\n\ng"),
        ("<main><p>a &lt;b&gt; &eacute; &#233;</p><aside>no</aside><form>no</form><div class='ad-box'>no</div><section id=comments><p>no</p></section></main>", "a <b> é é"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<script>var a = '<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", "yes"),
        ("<body class=has-sidebar><article class='post menu-x'><p>in</p></article></body>", "in"),
        ("<article><p>one\n two\t three</p><div class=newsletter>no</div></article>", "one two three"),
        ("", ""),
        ("plain", "plain"),
    ],
)
def test_main_text(page, want):
    assert html_extract.extract(page) == want


def test_odd_pages_are_read_in_proportion():
    import time

    began = time.perf_counter()
    assert html_extract.extract("<div>" * 20_000 + "deep" + "</div>" * 20_000 + "<p>after") == "deep\n\nafter"
    assert html_extract.extract("<div>" * 400 + "<nav>menu <b>bold</b></nav>kept" + "</div>" * 400) == "kept"
    assert "end" in html_extract.extract('<a "' * 20_000 + "<p>end</p>")
    assert html_extract.extract("<script" * 20_000 + "<p>x") is not None and html_extract.extract("x <script>" * 5000) == "x"
    assert html_extract.extract("<!--" * 20_000) == "" and html_extract.extract("<p>a < b <p>c") == "a < b\n\nc"
    assert html_extract.extract("<p title=\"a > b\">c</p><p title='>'>d</p><p title=\">e</p><p>f</p>") == "c\n\nd\n\ne\n\nf"
    wrapper = html_extract.wrapper_of(html_extract.parse("<div>" * 20_000 + "x"))
    html_extract.join_wrappers(wrapper, wrapper)
    assert time.perf_counter() - began < 20


def test_wrappers_don_t_grow_with_pages():
    import json

    wrapper = None
    for i in range(600):
        page = f"<body><div id=post-{i} class='c{i} post'><h1>t{i}</h1><p>x{i}</p></div>" + f"<b{'x' * (i % 599)}>z</b>"
        wrapper = html_extract.join_wrappers(wrapper, html_extract.wrapper_of(html_extract.parse(page)))
    assert len(json.dumps(wrapper)) < 200_000


def test_text_of_every_page(spark):
    """The texts of the test pages are their article elements, read by rule: tags off, references decoded, white space folded."""
    block = re.compile(r"</?(?:p|h1|article)\b[^>]*>")
    for r, got in ((r, None) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()):
        inner = re.search(r"(?s)<article>(.*?)</article>", r["html"])
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x)))).strip() for x in block.split(inner[1])] if inner else []
        got = html_extract.extract(r["html"])
        assert got == "\n\n".join(x for x in parts if x) or not inner, r["page_id"]


def test_registered():
    names = list(registry.queries())
    assert [next(n for n in names if n.startswith(f"op{i}_")) for i in range(1, 11)] and "pipeline" in names


def test_a_long_text_leaves_no_language_out(spark):
    """One text of 10 MB in each language, first or not by hash, and a language of one text."""
    from basketry.llm import language

    said = {"en": "the river went over the stones and under the bridge ", "de": "der Fluss ging über die Steine und unter der Brücke ", "fr": "la rivière passait sur les pierres et sous le pont "}
    rows = [(i * 3 + j, t[i % 20 :] + t, lang) for i in range(130) for j, (lang, t) in enumerate(said.items())]
    rows += [(1000 + j, t * (10_000_000 // len(t)), lang) for j, (lang, t) in enumerate(said.items())]
    rows += [(2001, "xyzzy plugh qwerty zork " * 400_000, "zz"), (2002, "zork plugh xyzzy", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert {i: lang for i, _, lang in rows if lang} == {i: got[i] for i, _, lang in rows if lang} and got[2002] == "zz"
    sizes = {r["lang"]: (r["n"], r["size"]) for r in language.sample(docs, 50, 40_000).groupBy("lang").agg(F.count("b").alias("n"), F.sum(F.octet_length("b")).alias("size")).collect()}
    assert sizes.keys() == {"en", "de", "fr", "zz"} and sizes["zz"] == (1, 10_000) and all(n <= 50 and size <= 50 * 256 for n, size in sizes.values())


PAGE = """<html><body><nav>Home</nav><article><h1>Title {0}</h1><h2 id="related-work">Related work {0}</h2><section id="menu-costs"><p>Menus cost {0}</p></section>
<p class="social-history">History {0}</p><div class="advert">Buy</div><div class="comment-list"><p>me too {0}</p></div><div class="promo-corner"><p>Read our best stories</p></div>
<p class="newsletter">Sign up now</p><p>The end of {0}.</p></article><footer>Rights</footer></body></html>"""


def test_words_of_subjects_stay_and_the_wrapper_tells_what_repeats():
    wrapper = None
    for i in range(5):
        wrapper = html_extract.join_wrappers(wrapper, html_extract.wrapper_of(html_extract.parse(PAGE.format(f"n{i}"))))
    kept = "Title z|Related work z|Menus cost z|History z".split("|")
    assert html_extract.extract(PAGE.format("z"), wrapper).split("\n\n") == [*kept, "The end of z."]
    # Without the wrapper nothing says that the last two are on every page.
    assert html_extract.extract(PAGE.format("z")).split("\n\n") == [*kept, "Read our best stories", "Sign up now", "The end of z."]


@pytest.mark.parametrize("deep", [100, 160, 1000, 70_000])
def test_articles_at_any_depth(deep):
    page = "<div>" * deep + "<article><p>first</p><div><nav>menu</nav>kept</div></article>" + "</div>" * deep + "<p>outside"
    wrapper = html_extract.wrapper_of(html_extract.parse(page))
    for _ in range(3):
        wrapper = html_extract.join_wrappers(wrapper, html_extract.wrapper_of(html_extract.parse(page.replace("first", "other"))))
    assert html_extract.extract(page, wrapper) == html_extract.extract(page) == "first\n\nkept"


def test_stray_tags_at_depth_take_no_long():
    assert html_extract.extract("<div><article>" + "<b>" * 30_000 + "x</div><li>" * 30_000 + "end").endswith("end")


def test_pages_through_spark_equal_pages_by_hand(spark):
    """Wrappers folded page by page in one place, and every page read with its host's."""
    rows = [(i, f"http://h{i % 3}.x/{i}", PAGE.format(f"n{i}") if i % 3 < 2 else f"<div><p>Welcome to us</p><h2>News</h2><p>story {i} told</p><p>All rights kept</p></div>") for i in range(36)]
    rows += [(100, None, "<p>alone"), (101, "http://h0.x/e", None), (102, "http://h1.x/e", "")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    by = {}
    for _, url, page in rows:
        host = re.sub(r"^http://([^/]*).*", r"\1", url or "")
        by[host] = html_extract.join_wrappers(by.get(host), html_extract.wrapper_of(html_extract.parse(page or "")))
    for i, url, page in rows:
        text = html_extract.extract(page or "", by[re.sub(r"^http://([^/]*).*", r"\1", url or "")])
        assert got[i] == (text, len(text))
    assert got[0][0].startswith("Title n0") and "best stories" not in got[0][0] and "story 2 told" in got[2][0]
