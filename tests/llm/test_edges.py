"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns."""

import pytest

import corpus_pipeline
from basketry.llm import decontaminate, exact_dedup, html_extract, language, line_dedup, packing, simhash, substring_dedup, toxicity, warc

LONG = "alpha beta gamma delta " * 60_000
ROWS = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "one two three", "en", "a", 13),
    (3, "one two three", "en", "b", 13),
    (4, "one two three", None, None, None),
    (5, " \n\t ", "de", "a", 4),
    (6, LONG, "en", "a", len(LONG)),
    (None, "no id", "en", "a", 5),
    (None, None, None, None, None),
    (3, "another text under a known id", "fr", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    # Extra columns with the names that operators use inside.
    for name in ("row", "idx", "name", "score", "root", "size", "label", "kept", "id", "_id", "_sha", "sha", "mark", "gone", "flags", "_key", "_tk", "tk", "h", "leaf", "n_lines", "n_dropped", "a.b", "of", "b", "clean", "item_id"):
        df = df.withColumn(name, df["n_chars"])
    return df.repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 1), (4, None, 0), (99, 1, 1), (None, 1, 0), (5, 0, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "..."), (None, "no id")], "item_id long, text string")


def ids(df, c="doc_id"):
    return sorted((r[c] for r in df.collect()), key=lambda x: (x is None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows if r["start"] == 0) == [(i is None, i or 0) for i in ALL]
    assert {r["length"] for r in rows if r["doc_id"] == 2} == {1}
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 4096
    assert packing.pack(none).count() == 0


def test_toxicity(docs, none, labels):
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 5)}) == 1
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).count() == len(ROWS)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_simhash(docs, none):
    rows = simhash.near_groups(docs).collect()
    assert len(rows) == len(ROWS)
    assert {(r["fp"], r["component_id"]) for r in rows if r["doc_id"] in (1, 2, 5)} == {(0, 1)}
    assert {r["component_id"] for r in rows if r["doc_id"] == 4} == {3}
    assert simhash.near_groups(none).count() == 0
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["text"] in (None, "", " \n\t ", "one two three")) == [1, 3]
    assert sorted((r["text"] or "") for r in left.collect()) == sorted({"" if (t or "").strip() == "" else t for _, t, *_ in ROWS})
    assert simhash.drop_near_copies(none).count() == 0


@pytest.mark.parametrize("block", [5, 8192])
def test_exact_dedup(docs, none, block):
    rows = exact_dedup.exact_groups(docs, block).collect()
    assert len(rows) == len(ROWS)
    assert {(r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] == 4} == {(4, 3)}
    assert {(r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] == 1} == {(2, 3)}
    left = exact_dedup.drop_copies(docs, block)
    assert sorted(r["doc_id"] for r in left.collect() if r["text"] in (None, "", "one two three")) == [2, 4]
    assert left.columns == docs.columns and sorted((r["text"] or "") for r in left.collect()) == sorted({t or "" for _, t, *_ in ROWS})
    assert exact_dedup.exact_groups(none, block).count() == 0


def test_line_dedup(docs, none):
    cleaned = line_dedup.clean_lines(docs, min_docs=2)
    assert sorted(cleaned.columns) == sorted(docs.columns)
    rows = cleaned.collect()
    assert len(rows) == len(ROWS)
    assert all(r["text"] is None and r["n_lines"] == 0 for r in rows if r["doc_id"] == 1)
    assert {r["text"] for r in rows if r["doc_id"] == 4} == {""}
    assert {r["n_dropped"] for r in rows if r["doc_id"] == 6} == {0}
    assert line_dedup.clean_lines(none).count() == 0


def test_templates_are_found_at_every_size(spark):
    line = "please send your letter to name{} in city{} before noon today"
    letters = "abcdefghijklmnopqrst"
    df = spark.createDataFrame([(20 * i + j, line.format(a, b)) for i, a in enumerate(letters) for j, b in enumerate(letters)], "doc_id long, text string")
    assert {r["n_dropped"] for r in line_dedup.clean_lines(df).collect()} == {1}
    assert {r["n_dropped"] for r in line_dedup.clean_lines(df.where("doc_id < 9")).collect()} == {0}


def test_exact_lines_count_for_their_template(spark):
    sections = ["news"] * 30 + "art food law film chess opera radio rugby yoga".split()
    df = spark.createDataFrame([(i, f"posted by the team in {x} section today") for i, x in enumerate(sections)], "doc_id long, text string")
    assert {r["n_dropped"] for r in line_dedup.clean_lines(df).collect()} == {1}


def test_substring_dedup(docs, none, spark):
    rows = substring_dedup.drop_repeats(docs).collect()
    assert len(rows) == len(ROWS) and all(r["n_removed"] == 0 for r in rows)
    assert {r["n_words"] for r in rows if r["doc_id"] == 6} == {240_000}
    assert substring_dedup.drop_repeats(none).count() == 0
    twice = spark.createDataFrame([(6, LONG), (7, LONG), (7, LONG), (None, LONG)], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_removed"]) for r in substring_dedup.drop_repeats(twice).collect())
    assert got == [((False, 6), 0), ((False, 7), 240_000), ((False, 7), 240_000), ((True, 0), 0)]


def test_decontamination(docs, none, items):
    rows = decontaminate.leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows if r["item_id"]) == [(3, 1), (3, 1), (4, 1)]
    left = decontaminate.drop_leaks(docs, items)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 4
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_language(docs, none):
    rows = language.identify(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 5)} == {"und"}
    assert language.identify(none).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    page = "<html><body><nav>menu</nav><article><h1>T</h1><p>one &amp; two<br>three</p></article></body></html>" + " " * 40
    data = [(1, "http://a.b/c", page), (2, "http://a.b/d", page), (3, None, page), (4, "x", None), (5, "http://a.b", ""), (5, "http://a.b", "<p>short"), (None, "http://a.b", page)]
    return spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "page_id AS host", "url AS text")


def test_html(pages):
    got = sorted(((r["page_id"] is None, r["page_id"] or 0), r["text"], r["n_chars"]) for r in html_extract.main_text(pages).collect())
    whole = "T\n\none & two three"
    assert got == [((False, 1), whole, 18), ((False, 2), whole, 18), ((False, 3), whole, 18), ((False, 4), "", 0), ((False, 5), "", 0), ((False, 5), "short", 5), ((True, 0), whole, 18)]
    assert html_extract.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc(spark, pages, tmp_path, compression):
    warc.register(spark)
    rows = pages.where("page_id IS NOT NULL").selectExpr("'response' AS record_type", "concat('<urn:page:', page_id, '>') AS record_id", "coalesce(url, '') AS target_uri", "CAST(NULL AS string) AS refers_to", "sha2(coalesce(html, ''), 256) AS payload_digest", "CAST(coalesce(html, '') AS binary) AS payload", "map('X', 'y') AS headers")
    rows.write.format("warc").option("compression", compression).mode("append").save(str(tmp_path / "w"))
    back = spark.read.format("warc").load(str(tmp_path / "w"))
    assert back.selectExpr("sha2(payload, 256) = payload_digest AS same").where("same").count() == 6
    some = spark.read.format("warc").option("payload", "false").load(str(tmp_path / "w")).where("target_uri = 'http://a.b/c'").collect()
    assert [(r["record_id"], r["payload"], r["headers"]["x"]) for r in some] == [("<urn:page:1>", None, "y")]
    assert back.where("record_type = 'revisit'").count() == 0
    rows.limit(0).write.format("warc").mode("append").save(str(tmp_path / "e"))
    assert spark.read.format("warc").load(str(tmp_path / "e")).count() == 0


def test_archive_of_pages(spark, pages, tmp_path):
    path = str(tmp_path / "a")
    warc.archive(pages, path)
    read = spark.read.format("warc").load(path)
    rows = [r.asDict() for r in read.collect()]
    assert len(rows) == 7 and all(r["record_id"] and r["headers"]["warc-date"] for r in rows)
    again = [r for r in rows if r["record_type"] == "revisit"]
    assert [(r["record_id"], r["refers_to"], r["headers"]["warc-profile"]) for r in again] == [("<urn:page:2>", "<urn:page:1>", warc.PROFILE)] or sorted(r["record_id"] for r in again) == ["<urn:page:2>", "<urn:page:3>"]
    warc.archive(pages.limit(0), path)
    warc.archive(pages.where("page_id = 1"), path)
    assert read.count() == 7 and spark.read.format("warc").load(path).count() == 8
    read.select("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload", "headers").limit(2).write.format("warc").mode("overwrite").save(str(tmp_path / "b"))
    read.select("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload", "headers").limit(3).write.format("warc").mode("overwrite").save(str(tmp_path / "b"))
    assert spark.read.format("warc").load(str(tmp_path / "b")).count() == 3


def test_archive_query_without_page_ids(spark, pages, tmp_path):
    for name, some in (("all", pages), ("none", pages.limit(0))):
        some.write.parquet(str(tmp_path / name / "pages.parquet"))
        rows = warc.op6_warc(spark, str(tmp_path / name)).collect()
        assert len(rows) == some.count()
        assert all(r["record_type"] == "response" and r["refers_to"] is None for r in rows if r["page_id"] in (None, 1, 4, 5))
        assert all(r["record_type"] == "revisit" and r["refers_to"] == 1 for r in rows if r["page_id"] in (2, 3))


def test_pipeline_stages_pass_all_columns(spark, docs, labels, items, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.where("item_id = 1").write.parquet(str(tmp_path / "benchmark.parquet"))
    df, empty = docs, docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df, empty = stage(spark, df, str(tmp_path)), stage(spark, empty, str(tmp_path))
        assert df.columns == docs.columns == empty.columns
        assert all(r["_id"] == r["n_chars"] == r["gone"] for r in df.collect())
    assert empty.count() == 0 and corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
    assert sorted((r["text"] or "").strip() for r in df.collect()) == sorted(["", "no id", "another text under a known id", LONG.strip()])
    assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).where("start = 0").count() == 4


def test_the_smallest_doc_id_of_near_copies_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    for order in ([9, 7, 5, 3, 1], [9, 1], [None, 4, 2]):
        df = spark.createDataFrame([(i, text + (" more" if n % 2 else "")) for n, i in enumerate(order)], "doc_id long, text string").repartition(3)
        assert [r["doc_id"] for r in simhash.drop_near_copies(df).collect()] == [min(i for i in order if i)]


def test_texts_that_share_a_name_are_told_apart(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, f"text number {i % 5} here") for i in range(8)], "doc_id long, text string")
    named = simhash.named_texts(df, lambda sha: F.lit(1).cast("long")).collect()
    assert len({r["id"] for r in named}) == len({r["text"] for r in named}) == len({(r["id"], r["text"]) for r in named}) == 5


def test_near_copies_by_partition_count(spark):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rng.sample(words, 80))) for i in range(1100)] + [(2000 + i, " ".join(words[:70] + [f"x{i % 3}"])) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(r["doc_id"] for r in simhash.drop_near_copies(df.repartition(n)).collect()) == [*range(1100), 2000]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
