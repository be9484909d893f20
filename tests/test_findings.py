"""Cases that reviews found wrong, each on tables made for it."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from basketry import session
from basketry.llm import graph as components_of
from basketry.llm import html_extract, packing, scoring, simhash
from basketry.operators import graph, matching, neighbours, search_index, skipgram, stats, vectors
from basketry.sources import keyed


def test_percentiles_are_rounded_as_by_sql(spark):
    rows = stats.rank_percentile(spark.range(1, 6001).select("id", "id").toDF("owner", "rank")).collect()
    sql = "SELECT i, round((1 - (i - 1) * 1.0 / 6000) * 100, 1) FROM range(1, 6001) t(i)"
    assert {r["owner"]: r["basicness"] for r in rows} == dict(duckdb.sql(sql).fetchall())


def test_candidates_of_one_title_meet_each_uri_once(spark):
    n = 20_000
    asked = spark.range(n).selectExpr("'LA' AS title", "'Ann' AS artist", "CAST(id % 17 AS DOUBLE) AS fit")
    known = spark.range(n).selectExpr("id AS uri", "'la' AS title", "'ANN' AS artist")
    features = spark.range(n).selectExpr("id AS uri", "0.5 AS energy", "0.1 AS valence")
    found = matching.qualified_candidates(asked, known, features)
    assert [(r["uri"], r["title"], r["fit"]) for r in found.orderBy("uri").collect()] == [(i, "LA", 16.0) for i in range(5)]
    # Before, every candidate met every uri: 400 million pairs.
    assert most_rows(found) <= n


def most_rows(df) -> int:
    """The most rows that a join of the query's plan puts out."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            plan.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            plan.append(node.plan())
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_nearest_vectors_without_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(5)]) for i in range(600)]
    rows += [(i, rows[i % 7][1]) for i in range(600, 700)] + [(700, [0.0] * 5), (701, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    asked = df.where("id % 50 = 0").toDF("query_id", "query")
    for own in (True, False):
        pairs = df.where("vector IS NOT NULL").crossJoin(asked).where("query IS NOT NULL")
        pairs = pairs.where("id <> query_id") if own else pairs
        pairs = pairs.select("query_id", "id", F.round(vectors.cosine(F.col("vector"), F.col("query")), 6).alias("similarity"))
        want = pairs.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)")).where("rank <= 30")
        found = vectors.top_k(df, asked, 30, own)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
        assert most_rows(found) == 0
    index, centres = vectors.list_index(df.where("vector IS NOT NULL"), 4)
    lists = vectors.search_lists(index, centres, asked, 10, 4)
    assert {(r["query_id"], r["similarity"]) for r in lists.where("rank = 1").collect()} == {(i, 0.0 if i == 700 else 1.0) for i in range(0, 701, 50)}
    assert lists.where("rank = 1 AND id <> query_id").isEmpty() and most_rows(lists) == 0
    near = {(r["query_id"], r["id"]) for r in lists.collect()}
    exact = {(r["query_id"], r["id"]) for r in vectors.top_k(df, asked.where("query_id <> 700"), 10, False).collect()}
    assert len(near & exact) >= 0.99 * len(exact)


def test_shares_of_tables_stay_the_same(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    rows = spark.range(2000).selectExpr("id % 300 AS pid", "id % 7 AS node", "id % 300 AS key", "id AS item")
    names = spark.range(300).selectExpr("id AS pid", "'x' AS name")
    for found in (graph.cooccurrence(rows, "pid", "node"), matching.orphans(rows, rows, "key"), stats.item_stats(rows, names, "item", "pid")):
        assert "REPARTITION_BY_NUM" in (plan := found._jdf.queryExecution().toString()) and ", 40)" in plan or ", 80)" in plan
    assert matching.orphans(rows, spark.range(299).select(F.col("id").alias("key")), "key").collect() == [("left", 299)]


def test_a_batch_is_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(100).mapInArrow(count, "id long").selectExpr("id AS k", "1 AS v")
    keyed.change(rows, str(tmp_path / "t"), ["k"], keyed.summed("v"), "one")
    assert keyed.read(spark, str(tmp_path / "t")).count() == made.value == 100


def test_descent_puts_out_what_may_change_a_list(spark):
    rows = np.eye(4)
    batch = pa.RecordBatch.from_arrays([pa.array([[0, 1, 2, 3]]), pa.array([rows.tolist()]), pa.array([[0.5, 0.5, -2.0, 0.5]])], ["id", "vector", "least"])
    found = [r for b in neighbours._local(2)([batch]) for r in b.to_pylist()]
    assert {r["id"] for r in found} == {2} and len(found) == 2


def test_turns_of_skip_gram_are_bounded_while_a_block_holds_its_words(spark, tmp_path, monkeypatch):
    turns = []
    learned = skipgram._learned
    monkeypatch.setattr(skipgram, "_learned", lambda *a: turns.append(a[3]) or learned(*a))
    monkeypatch.setattr(skipgram, "SPLIT_WORDS", 10)
    rng = np.random.default_rng(1)
    rows = [(i, [f"g{i % 4}w{j}" for j in rng.integers(0, 60, 8)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "sequence long, tokens array<string>")
    got = skipgram.skip_gram(df, str(tmp_path), 8, 5, 5, passes=1)
    # Blocks of ten words made 24 turns, each of which passed the whole model on.
    assert got.count() == 240 and turns == list(range(12))


def test_no_row_holds_a_block_of_skip_gram(spark, tmp_path, monkeypatch):
    kept, longest = skipgram.written, []

    def written(df, *a):
        out = kept(df, *a)
        if "data" in out.columns:
            longest.append(out.agg(F.max(F.length("data"))).first()[0])
        return out

    monkeypatch.setattr(skipgram, "written", written)
    rng = np.random.default_rng(1)
    rows = [(i, [f"w{j}" for j in rng.integers(0, 240, 8)]) for i in range(1200)]
    got = skipgram.skip_gram(spark.createDataFrame(rows, "sequence long, tokens array<string>"), str(tmp_path), 64, 5, 5, passes=1)
    # A block's vectors were one value of 61,440 bytes; readers and writers hold many rows at once, whatever their bytes.
    assert got.count() == 240 and got.where("size(vector) = 64").count() == 240
    assert len(longest) >= 2 and max(longest) <= 2048


def test_skip_gram_does_without_words_in_a_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(skipgram, "SPLIT_WORDS", 1)
    rows = [(i, [f"w{(i + j) % 5}" for j in range(4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "sequence long, tokens array<string>")
    # Five words fill four of five blocks; a block of contexts that isn't there ended the run.
    assert spark.range(5).select(F.expr("pmod(xxhash64(concat('w', id)), 5)")).distinct().count() < 5
    assert sorted(r["word"] for r in skipgram.skip_gram(df, str(tmp_path), 8, 3, 5, passes=1, often=1.0).collect()) == [f"w{i}" for i in range(5)]


def test_a_bucket_of_skip_gram_is_learned_from_in_parts(spark, tmp_path, monkeypatch):
    held, learn = [], skipgram.train
    monkeypatch.setattr(skipgram, "BUCKET_PAIRS", 100)
    monkeypatch.setattr(skipgram, "train", lambda words, contexts, weight, c, *a: held.append(len(c)) or learn(words, contexts, weight, c, *a))
    rng, n = np.random.default_rng(3), 250
    model = [pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(b), pa.int32())], ["c_block", "side", "place", "size", "data", "o"]) for side, m in (("words", rng.random((7, 8)).astype(np.float32)), ("contexts", np.zeros((9, 8), np.float32)), ("weight", np.ones(9))) for b in skipgram._rows(0, side, m)]
    pairs = [pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.string()), pa.array(rng.integers(0, 7, n).astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(rng.integers(0, 9, n).astype(np.int32))]
    out = list(skipgram._learned(8, 5, 1, 0, (0.05, 0.04), (7, 0, 0))([*model, pa.RecordBatch.from_arrays(pairs, model[0].schema.names)]))
    assert held == [100, 100, 50]
    sides = {side: m for b in out for _, _, side, m in skipgram._parts(b, 8)}
    assert sides["words"].shape == (7, 8) and sides["contexts"].shape == (9, 8) and np.abs(sides["contexts"]).min() > 0


def test_track2vec_keeps_no_vocabulary_in_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("pyspark.ml.feature.Word2Vec.fit", None)
    rows = [(i, [f"g{i % 2}w{j}" for j in np.random.default_rng(i).integers(0, 9, 8)]) for i in range(2000)]
    df = vectors.sequence_embeddings(spark.createDataFrame(rows, "sequence long, tokens array<string>"), str(tmp_path), passes=20)
    assert df.dtypes == [("word", "string"), ("vector", "array<double>")]
    got = {r["word"]: np.array(r["vector"]) / np.linalg.norm(r["vector"]) for r in df.collect()}
    names = sorted(got)
    near = np.stack([got[w] for w in names]) @ np.stack([got[w] for w in names]).T
    same = np.array([[a[:2] == b[:2] for b in names] for a in names])
    assert len(names) == 18 and near[same].mean() > near[~same].mean() + 0.3


def test_a_wrapper_remembers_all_children():
    kids = "".join(f"<{'div' if i % 2 else 'section'} class=\"k{'abcdefghij'[i // 100]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}\">{{0}}</{'div' if i % 2 else 'section'}>" for i in range(400))
    page = "<article>" + kids + "{1}<p class=\"notice-x\">Read our terms</p></article>"
    wrapper = None
    for i in range(4):
        # One page has a child more, so that lists of different length are aligned; only 300 children stayed then.
        one = page.format(i, "<h2>more</h2>" if i == 3 else "")
        wrapper = html_extract.join_wrappers(wrapper, html_extract.wrapper_of(html_extract.parse(one)))
    assert html_extract.extract(page.format(9, ""), wrapper) == "\n\n".join(["9"] * 400)


def apart(text: bytes):
    """Bands that no other text has."""
    return np.frombuffer(str(hash(text)).encode().ljust(8 * simhash.BANDS, b" ")[: 8 * simhash.BANDS], np.uint64), 1


def test_near_copies_come_from_simhash_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "bands", apart)
    words = np.random.default_rng(2).integers(0, 5000, (6, 4000))
    texts = [" ".join(map(str, w)) for w in words]
    print_of = lambda t: simhash.fingerprint(t.encode(), simhash.SHINGLE)
    # The first text with some last words taken off whose fingerprint differs, in two bits at most.
    near = [next(c for n in range(1, 300) if print_of(c := t.rsplit(" ", n)[0]) != print_of(t)) for t in texts[:3]]
    assert all((print_of(a) ^ print_of(b)).bit_count() <= 2 for a, b in zip(texts, near, strict=False))
    df = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(df).collect()) == list(range(6))


def test_a_small_graph_takes_no_rounds(spark, monkeypatch):
    made = []
    cut = components_of.cut
    monkeypatch.setattr(components_of, "cut", lambda df: made.append(1) or cut(df))
    edges = [(int(a), int(b)) for a, b in np.random.default_rng(5).integers(-300, 300, (260, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    df = spark.createDataFrame(edges, "a long, b long")
    at_once = sorted(map(tuple, components_of.components(df).collect()))
    # Before, each round made two checkpoints more, each with as many tasks as there are shuffle partitions.
    assert len(made) == 2
    monkeypatch.setattr(components_of, "SHARE", 50)
    assert sorted(map(tuple, components_of.components(df).collect())) == at_once and len(made) > 6
    assert components_of.components(df.where("a > 9999")).isEmpty()


def test_start_weights_of_scores_come_from_no_sample(spark, tmp_path):
    rows = [(i, " ".join(f"w{j}" for j in np.random.default_rng(i).integers(0, 40, 60))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "CAST(text AS binary) AS b")
    found = [scoring.learn(df.where(f"doc_id % 2 = {i}"), str(tmp_path / str(i))).mixer.weights for i in (0, 1)]
    # Before, they were fitted to 192 of the texts.
    assert found[0].shape == (scoring.GATES, scoring.CONTEXTS + 1) and (found[0] == found[1]).all()
    assert (found[0][-1] == np.array(scoring.START[-1], np.float32)).all() and (found[0][0] == np.array(scoring.START[0], np.float32)).all()


def test_counting_holds_few_bits_at_a_time():
    line = np.frombuffer(b"".join(b"w%d of stone " % (i * i % 7001) for i in range(60_000)), np.uint8)
    trees, ends = scoring.Trees(np.ones((256, 256))), np.array([400_001, 400_002, len(line)])
    text, begin, end = scoring.pieces(ends)
    first = np.concatenate([[0], ends[:-1]])[text]
    tracemalloc.start()
    got = [(at, n) for _, at, n in scoring.counted(trees, line, first, begin, end, 16)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Before, the eight bits of every byte were held, at eight bytes each, and sorted.
    assert peak < 64 * len(line)
    pair, places = scoring.contexts(line, first, begin, end, 16)
    size = trees.size[pair]
    path = trees.path[np.repeat(trees.start[pair] - (np.cumsum(size) - size), size) + np.arange(size.sum())].astype(np.int64)
    for k, (at, n) in enumerate(got):
        want = np.unique((np.repeat(scoring.place(places, k), size) ^ path & 255) << 1 | path >> 8 & 1, return_counts=True)
        assert (at == want[0]).all() and (n == want[1]).all() and n.sum() == 8 * len(line)


def test_an_index_shuffles_lists_and_no_single_postings(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(i % 250 - 20, f"Red blue{i % 3} 1\u212a x-red\u00e9red") for i in range(300)] + [(5, "red"), (None, "red"), (6, None), (900, "\u00e9 -")]
    search_index.store(spark.createDataFrame(rows, "id long, text string").repartition(4), path)
    # Before, a row for each word of each text: 1,300.
    assert spark.read.parquet(f"{path}/postings").count() <= 4 * 20
    found = {r["id"]: r["n"] for r in search_index.postings(spark, path, ["red"]).collect()}
    assert found == {i: 3 * (2 if i < 30 else 1) + (i == 5) for i in range(-20, 230)}
    tokens = {r["token"]: (r["texts"], r["times"]) for r in search_index.tokens(spark, path).collect()}
    assert tokens["red"] == (250, 901) and tokens["1k"] == (250, 300) and tokens.keys() == {"red", "blue0", "blue1", "blue2", "1k", "x"}
    assert sum(r["tokens"] for r in spark.read.parquet(f"{path}/lengths").collect()) == 300 * 6 + 1


def test_clusters_are_labelled_in_one_pass(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    points = spark.range(60).selectExpr("id", "id / 3 AS x", "IF(id % 5 = 0, NULL, -id / 7) AS y", "CAST(id % 4 AS INT) AS cluster_id").mapInArrow(count, "id long, x double, y double, cluster_id int")
    labels = spark.range(60).selectExpr("id", "concat('genre ', id % 3) AS label")
    got = vectors.cluster_labels(points, labels).collect()
    assert read.value == 60  # 120 before
    own = lambda c: [i for i in range(60) if i % 4 == c]
    mean = lambda x: sum(x) / len(x)
    want = {c: ("Genre 0", mean([i / 3 for i in own(c)]), mean([-i / 7 for i in own(c) if i % 5]), 15) for c in range(4)}
    assert {r["cluster_id"]: r["size"] for r in got} == dict.fromkeys(range(4), 15)
    assert all(r["label"] == want[r["cluster_id"]][0] and np.allclose((r["cx"], r["cy"]), want[r["cluster_id"]][1:3], atol=1e-6) for r in got)


def test_words_known_whole_are_not_parted_again(monkeypatch):
    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    texts = pa.array(["The end, the END. \u00c9t\u00e9! x9?? don't</s>", "", "a" * 200 + "!", "the end,\n</s>"])
    first = [x.tolist() for x in encode(texts)]
    assert first == [encode.model.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
    parted, asked = encode._ids, []
    monkeypatch.setattr(encode, "_ids", lambda words: asked.extend(words.to_pylist()) or parted(words))
    assert [x.tolist() for x in encode(texts)] == first
    # Before, all words were parted and looked up anew in each batch; now only what is too long to be kept.
    assert set(asked) <= {"a" * 200, "!", ""}
