"""Every query with SQL against that SQL, and the others for their invariants, on the smallest tables."""

import pytest

from basketry.plans import registry, vectors_quality

from .oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, con, tmp_path, name):
    assert differences(con, registry.queries()[name](spark, SF), registry.oracle_sql()[name], str(tmp_path / "out")) == (0, 0)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_context_shares_are_bounded(spark):
    for row in registry.queries()["habitat_two_level"](spark, SF).collect():
        for c in ("home", "work", "rush", "slow"):
            assert 0 <= row[c] <= row["basket_count"] and 0 <= row[f"{c}_pct"] <= 100


def test_assignments_cover_matches(spark):
    rows = registry.queries()["mood_map_clusters"](spark, SF).collect()
    assert all(r["assignments"] >= r["total_matched"] for r in rows)
    assert sum(r["count"] for r in rows) == rows[0]["assignments"]


def test_routes_and_names_are_stable(spark):
    q = registry.queries()
    for name in ("transition_beam", "soundtrack_beam", "name_generator"):
        assert q[name](spark, SF).collect() == q[name](spark, SF).collect()
    assert [r["stage"] for r in q["transition_beam"](spark, SF).collect()] == [1, 2, 3]
    assert [r["role"] for r in q["soundtrack_beam"](spark, SF).collect()] == ["opener", "build", "anchor", "peak", "wind_down", "closer"]


def test_clusters_cover_all_vectors(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert sum(r["size"] for r in registry.queries()["umap_substitute_clusters"](spark, SF).collect()) == n


def test_queries_read_whole_tables(spark):
    q = registry.queries()
    parts, orders, items = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("part", "orders", "lineitem"))
    assert q["fill_empty_lists"](spark, SF).count() == parts.count()
    assert q["coerced_key_patch"](spark, SF).count() == q["two_hop_counts"](spark, SF).count() == orders.count()
    assert q["song_passport"](spark, SF).count() == items.select("l_partkey").distinct().count()
    for name in ("playlist_profile", "title_roast"):
        assert q[name](spark, SF).select("id").distinct().count() == parts.count()
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").count()
    assert q["vector_topk_cosine"](spark, SF).count() == 10 * asked


def test_lists_find_what_all_vectors_have(spark):
    q = registry.queries()
    sf = "/root/testdata/sf0.01"
    found = q["vector_lists_search"](spark, sf).collect()
    asked = {r["query_id"] for r in found}
    assert all(r["id"] == r["query_id"] for r in found if r["rank"] == 1) and len(asked) > 3
    exact = {(r["query_id"], r["id"]) for r in q["vector_topk_cosine"](spark, sf).where("rank < 10").collect()}
    got = {(r["query_id"], r["id"]) for r in found if r["rank"] > 1}
    assert len(exact & got) >= 0.9 * len(exact)


def test_substrings_by_brute_force(spark):
    from basketry.operators import matching

    texts = [(1, "An Apple a day"), (2, None), (3, ""), (4, "apple apple"), (4, "pie")]
    asked = [(1, "APPLE"), (2, "a d"), (3, ""), (4, None), (5, "apple"), (6, "zzz")]
    got = matching.substring_hits(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(asked, "query_id int, query string"))
    assert {(r["query_id"], r["hits"]) for r in got.collect()} == {(1, 2), (2, 1), (5, 2)}


def test_patterns_that_are_none_are_looked_for_as_they_stand(spark):
    from basketry.operators import matching

    names = spark.createDataFrame([("Sm(le", 3), ("smile", 9), ("Smi", 1)], "name string, basket_count int")
    assert [matching.resolve_pattern(names, w).first()["name"] for w in ("m(", "s.i", "SMI", "i")] == ["Sm(le", "smile", "Smi", "smile"]


def test_soundtrack_takes_the_whole_pool(spark, monkeypatch):
    pools = []
    monkeypatch.setattr(vectors_quality.v, "soundtrack", lambda s, c, prompt, pool=10_000: pools.append(pool))
    registry.queries()["soundtrack_beam"](spark, SF)
    assert pools == [10_000]
