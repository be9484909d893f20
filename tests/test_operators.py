"""Operators on small tables whose answers can be seen by inspection."""

import datetime

import pytest
from pyspark.sql import functions as F

from basketry.functions import text
from basketry.operators import archive, graph, listening, matching, quality, stats, vectors
from basketry.sources import readers, writers


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "t1", "A"), (1, "t2", "A"), (1, "t2", "A"), (2, "t1", "A"), (2, "t3", "B"), (3, "t2", "A"), (3, "t3", "B")]
    return spark.createDataFrame(data, "pid int, item string, owner string")


def test_reach_counts_a_basket_once(rows):
    got = {r["owner"]: (r["basket_count"], r["rank"]) for r in stats.reach_rank(rows, "owner", "pid").collect()}
    assert got == {"A": (3, 1), "B": (2, 2)}


def test_edges(rows):
    assert [tuple(r) for r in graph.cooccurrence(rows, "pid", "owner").collect()] == [("A", "B", 2)]
    assert graph.cooccurrence(rows, "pid", "owner", 3).count() == 0


def test_blend_and_collision(spark):
    edges = spark.createDataFrame([(1, 3, 4), (2, 3, 4), (1, 4, 2), (2, 4, 6), (1, 5, 9)], "a int, b int, weight long")
    got = {r["node"]: r["blend_score"] for r in graph.blend(edges, [1, 2]).collect()}
    assert got == {3: 1.0, 4: 0.75}
    counts = spark.createDataFrame([(3, 1), (4, 1), (5, 1)], "owner int, basket_count long")
    assert [(r["bridge"], r["score"]) for r in graph.collision(edges, counts, 1, 2).collect()] == [(3, 4.0), (4, 3.0)]
    lone = spark.createDataFrame([(1, 3, 4), (2, 4, 6)], "a int, b int, weight long")
    assert {r["blend_score"] for r in graph.blend(lone, [1, 2]).collect()} == {0.0}


def test_paths(spark):
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 4), (3, 4, 3), (1, 5, 1), (4, 5, 1)], "a int, b int, weight long")
    assert [(r["hop"], r["node"], r["shared"]) for r in graph.six_degrees(spark, edges, 1, 4, 6, 2).orderBy("hop").collect()] == [(0, 1, None), (1, 5, 1), (2, 4, 1)]
    assert [r["node"] for r in graph.six_degrees(spark, edges, 1, 1).collect()] == [1]
    assert graph.six_degrees(spark, edges, 1, 9).count() == 0


def test_bounded_and_loose_keywords(spark):
    df = spark.createDataFrame([("workout mix",), ("brunch",), ("work hard",), ("Run club",)], "t string")
    low = F.lower("t")
    assert [r[0] for r in df.where(low.rlike(text.loose(["run"]))).collect()] == ["brunch", "Run club"]
    assert [r[0] for r in df.where(low.rlike(text.bounded(["work"]))).collect()] == ["work hard"]
    df = spark.createDataFrame([("sadé mix",), ("so sad",), ("sad_one",), ("sad-ish",), ("ésad",), ("sad",)], "t string")
    assert [r[0] for r in df.where(F.lower("t").rlike(text.bounded(["sad", "none"]))).collect()] == ["so sad", "sad-ish", "sad"]


@pytest.mark.parametrize(
    ("title", "want"),
    [("Song (feat. X & Y)", "Song"), ("Song - Remastered 2009", "Song"), ("Song (Live Remaster)", "Song"), ("Song - Radio Edit", "Song"), ("Song ft. A", "Song"), ("Plain", "Plain")],
)
def test_clean_title(spark, title, want):
    assert spark.createDataFrame([(title,)], "t string").select(text.clean_title(F.col("t"))).first()[0] == want


def test_text_forms(spark):
    row = spark.createDataFrame([("  Thé, Song!  of 12 a", ["rock", "pop"], ["rock", "jazz"], [])], "t string, a array<string>, b array<string>, c array<string>")
    got = row.select(text.canonical(F.col("t")), text.tokens(F.col("t")), text.jaccard(F.col("a"), F.col("b")), text.jaccard(F.col("a"), F.col("c")), text.jaccard(F.col("c"), F.col("c")), text.theme(F.lit("late gym")), text.genre_color(F.lit("Indie Rock"))).first()
    assert tuple(got) == ("thé song of 12 a", ["thé"], 1 / 3, 0.0, 0.0, "activity", "#C084FC")
    more = row.select(text.url_to_uri(F.lit("https://x.y/track/abc?z=1")), text.profile_words(F.lit("Mum's best 9 x")), text.roast_words(F.lit("Big, sad/ok & fun")), text.unfence(F.lit('```json\n{"a": 1}\n```')), text.decade(F.lit(1999))).first()
    assert tuple(more) == ("track:abc", ["mum", "best"], ["big", "sad", "fun"], '{"a": 1}', 1990)


def test_lifetimes(spark):
    d = datetime.date
    rows = spark.createDataFrame([(1, 1, d(2020, 1, 10), d(2020, 1, 5)), (2, 1, d(2020, 1, 1), None), (3, 2, d(2020, 1, 1), d(2020, 3, 1))], "id int, pl int, added date, removed date")
    names = spark.createDataFrame([(1, "Learn Spanish"), (2, "Hits")], "pl int, playlist_name string")
    got = archive.lifetimes(rows, names, "pl")
    assert {r["id"]: r["days_on"] for r in got.collect()} == {1: 0, 3: 60}
    assert [r["id"] for r in archive.music_only(got, None, "playlist_name").collect()] == [3]


def test_chart_history(spark):
    d = datetime.date
    rows = spark.createDataFrame([("u", "n1", d(2020, 1, 2), 5, 10), ("u", "n2", d(2020, 1, 9), 2, 30), ("u", "n2", d(2020, 1, 16), 2, 20)], "track string, name string, week date, rank int, streams long")
    r = archive.chart_history(rows).first()
    assert (r["name"], r["chart_peak"], r["total_weeks"], r["peak_date"], r["total_streams"]) == ("n1", 2, 3, d(2020, 1, 9), 60)


def test_eras(spark):
    assert archive.era("90s") == (1990, 1999) and archive.era("1987") == (1987, 1987) and archive.era("love") is None
    with pytest.raises(ValueError):
        archive.era("2020s")
    spine = spark.createDataFrame([(i,) for i in range(4)], "id int")
    years = spark.createDataFrame([(0, 2016), (1, 2018), (3, 1939)], "id int, year int")
    more = spark.createDataFrame([(0, 1999), (2, None)], "id int, year int")
    got = archive.in_era(archive.era_tracks(spine, years, more, 2017), 0, 9999)
    assert [(r["id"], r["release_year"], r["year_source"]) for r in got.collect()] == [(0, 2016, "first")]


def test_identities(spark):
    a, b = spark.createDataFrame([("x", 1), ("z", None)], "k string, v int"), spark.createDataFrame([("y", 2), ("z", 3)], "k string, v int")
    got = {r["k"]: (r["v"], r["source_flags"], r["match_method"]) for r in matching.merge_identities(a, b, "k", ["v"]).collect()}
    assert got == {"x": (1, 1, "a_only"), "y": (2, 4, "b_only"), "z": (3, 5, "a+b")}


def test_sessions(spark):
    t = datetime.datetime
    rows = [(1, 1, t(2024, 1, 1, 0, 0), 1), (2, 1, t(2024, 1, 1, 0, 30), 1), (3, 1, t(2024, 1, 1, 1, 0, 1), 1)]
    got = listening.sessions(spark.createDataFrame(rows, "event_id int, user_id int, ts timestamp_ntz, ms long"))
    assert sorted(r["plays"] for r in got.collect()) == [1, 2]


def test_circular_hours(spark):
    t = datetime.datetime
    r = listening.artist_clock(spark.createDataFrame([("a", t(2024, 1, 1, 23)), ("a", t(2024, 1, 1, 1))], "artist string, ts timestamp_ntz")).first()
    assert r["mean_hour"] == 0.0


def test_percent_rank_passes_over_zero(spark):
    s = spark.createDataFrame([("a", 10), ("b", 10), ("c", 30), ("d", 0), ("e", None)], "name string, x long")
    got = {r["name"]: r["current_pct"] for r in stats.signal_rank({"x": s}, "name").collect()}
    assert got == {"a": 0.0, "b": 0.0, "c": 100.0, "d": None, "e": None}


def test_substring_queries(spark):
    asked = spark.createDataFrame([(1, "love", ""), (2, "love", "dr"), (3, "hate", "")], "query_id int, title string, artist string")
    known = spark.createDataFrame([("My Love", "Zed")], "r_title string, r_artist string")
    r = matching.forensics(asked, known).first()
    assert (r["hits"], r["total"], r["pct"], r["verdict"]) == (1, 3, 33.0, "some_reference_overlap")


def test_guards(spark):
    df = spark.createDataFrame([("a",), (" ",), (None,)], "x string")
    assert not quality.blank_guard(df, "x").first()["ok"]
    with pytest.raises(ValueError):
        quality.require_filled(df, "x")
    with pytest.raises(ValueError):
        archive.era("2025")


def test_cosine_edges(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [2.0, 0.0])], "a array<double>, z array<double>, b array<double>")
    got = row.select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z")), vectors.lerp(F.col("a"), F.col("b"), 0.5)).first()
    assert tuple(got) == (1.0, 0.0, [1.5, 0.0])
    assert vectors.prompt_context("a rainy late-night drive") == "road_trip" and vectors.prompt_context("zzz") == "chill"


def test_readers(spark, tmp_path):
    (tmp_path / "d.tsv").write_text('1\ta "b\t\\N\n2\tc\n')
    got = readers.dump(spark, str(tmp_path / "d.tsv"), "id int, name string, year int")
    assert [tuple(r) for r in got.collect()] == [(1, 'a "b', None), (2, "c", None)]
    (tmp_path / "l.txt").write_text("1\t2\nx\t3\n1\t2\t3\n4\t5\n")
    assert [tuple(r) for r in readers.guarded_lines(spark, str(tmp_path / "l.txt"), "a int, b int").collect()] == [(1, 2), (4, 5)]
    (tmp_path / "charts").mkdir()
    (tmp_path / "charts" / "top-2020-01-02.csv").write_text("rank,uri\n" + "".join(f"{i},u{i}\n" for i in range(1, 13)))
    (tmp_path / "charts" / "top-2020-01-09.csv").write_text("<html>\n<body>\n")
    charts = readers.dated_charts(spark, str(tmp_path / "charts"), "rank int, uri string")
    assert charts.count() == 12 and {r["date"] for r in charts.collect()} == {datetime.date(2020, 1, 2)}
    (tmp_path / "m.csv").write_text("track,,album\nid,title,name\n1,x,y\n2,z,\n")
    many = readers.multi_header(spark, str(tmp_path / "m.csv"))
    assert many.columns == ["track_id", "track_title", "album_name"] and many.count() == 2


def test_nested_json(spark, tmp_path):
    (tmp_path / "slice.json").write_text('{"playlists": [{"pid": 1, "name": "n", "collaborative": "true", "tracks": [{"pos": 0, "track_uri": "u", "track_name": "first"}]}, {"pid": 2, "collaborative": "false", "tracks": [{"pos": 0, "track_uri": "u", "track_name": "later"}]}]}')
    lists, tracks, places = readers.playlist_slices(spark, str(tmp_path / "slice.json"))
    assert [r["collaborative"] for r in lists.orderBy("pid").collect()] == [True, False]
    assert [r["track_name"] for r in tracks.collect()] == ["first"] and places.count() == 2
    (tmp_path / "arch").mkdir()
    (tmp_path / "arch" / "p1.json").write_text('{"name": "N", "tracks": [{"url": "https://open.player.com/track/abc?si=1", "name": "T", "artists": [{"name": "A"}, {"name": "B"}], "added_at": "2020-01-01*"}, {"url": "", "name": "gone"}]}')
    (tmp_path / "arch" / "bad.json").write_text("{nope")
    lists, tracks = readers.archives(spark, str(tmp_path / "arch"))
    r = tracks.first()
    assert lists.count() == 1 and tracks.count() == 1
    assert (r["track_uri"], r["artist_name"], r["date_added"], r["date_added_asterisk"]) == ("player:track:abc", "A", "2020-01-01", True)


def test_list_page(spark):
    html = '<h3 class="t">A &amp; B</h3><h4><span>E</span>Someone</h4><h3>C</h3><h4>Other</h4>'
    got = readers.track_list(spark.createDataFrame([(1, html)], "page_id int, html string"))
    assert [(r["title"], r["artist"]) for r in got.orderBy("pos").collect()] == [("A & B", "Someone"), ("C", "Other")]


def test_lookup_is_sorted(spark, tmp_path):
    writers.lookup(spark.range(1000).selectExpr("id", "concat('k', id % 37) AS k"), str(tmp_path / "out"), ["k"], 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 1000 and back.where("k = 'k5'").count() == 27


def test_streaming_sessions(spark, tmp_path):
    from basketry.streaming import history

    plays = spark.createDataFrame([(1, 1, datetime.datetime(2024, 1, 1, h, m), 5) for h, m in ((0, 0), (0, 20), (3, 0))], "event_id int, user_id int, ts timestamp_ntz, ms long")
    plays.write.parquet(str(tmp_path / "in"))
    stream = history.sessions(spark.readStream.schema(plays.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("streamed_sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["plays"] for r in spark.table("streamed_sessions").collect()) == [1, 2]


def test_small_forms(spark, tmp_path):
    import numpy as np

    row = spark.createDataFrame([("frida  kahlo x", "", '```json\n{"mood": "sad", "energy": "huge"}```')], "n string, e string, j string")
    got = row.select(text.initials(F.col("n")), text.initials(F.col("e")), text.parsed_choice(F.col("j"), {"mood": ["sad"], "energy": ["low"]}).alias("c")).first()
    assert (got[0], got[1], got["c"]["mood"], got["c"]["energy"]) == ("FK", "?", "sad", None)
    np.save(tmp_path / "m.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    assert [(r["idx"], r["vector"]) for r in readers.matrix(spark, str(tmp_path / "m.npy"), 3).orderBy("idx").collect()][3] == (3, [9.0, 10.0, 11.0])
    (tmp_path / "x.json").write_text('{"rows": 3}')
    assert readers.manifest(spark, str(tmp_path / "x.json")).first()["rows"] == 3
    ids = spark.range(100)
    assert quality.sample(ids, "id", 7).collect() == quality.sample(ids.repartition(5), "id", 7).collect() and quality.sample(ids, "id", 200).count() == 100


def test_places_and_running_sums_over_partitions(spark):
    rows = spark.range(500).selectExpr("id", "id % 7 AS n").repartition(9)
    got = stats.placed(rows, [F.desc("n"), F.col("id")], "n").collect()
    want = sorted(((i, i % 7) for i in range(500)), key=lambda x: (-x[1], x[0]))
    assert sorted((r["place"], r["id"]) for r in got) == [(p + 1, i) for p, (i, _) in enumerate(want)]
    sums = [sum(n for _, n in want[: p + 1]) for p in range(500)]
    assert [r["running"] for r in sorted(got, key=lambda r: r["place"])] == sums
    assert stats.placed(rows.where("id < 0"), [F.col("id")], "n").count() == 0


def test_query_blocks_change_nothing(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 5), float(i % 3) - 1, 1.0]) for i in range(30)] + [(30, None)], "id int, vector array<double>")
    asked = rows.where("id % 4 = 2").toDF("query_id", "query")
    whole = sorted(map(tuple, vectors.top_k(rows, asked, 4).collect()))
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 200)
    assert sorted(map(tuple, vectors.top_k(rows, asked, 4).collect())) == whole
    assert {r[0] for r in whole} == {i for i in range(30) if i % 4 == 2}
    assert vectors.top_k(rows, asked.where("query_id < 0"), 4).count() == 0


def test_list_parts_change_nothing(spark):
    rows = spark.createDataFrame([(i, [float(i % 11), float(i % 7) - 3, 1.0]) for i in range(200)], "id int, vector array<double>")
    index, centres = vectors.list_index(rows, 4)
    asked = rows.where("id % 20 = 0").toDF("query_id", "query")
    few = sorted(map(tuple, vectors.search_lists(index, centres, asked, 5, 2).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert sorted(map(tuple, vectors.search_lists(index, centres, asked, 5, 2).collect())) == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lookup_row_groups_are_apart(spark, tmp_path):
    import pyarrow.parquet as pq

    writers.lookup(spark.range(5000).selectExpr("(id * 7919) % 5000 AS k", "id"), str(tmp_path / "out"), ["k"], 4)
    spans = []
    for f in (tmp_path / "out").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(0).statistics
            spans.append((s.min, s.max))
    spans.sort()
    assert len(spans) >= 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_details_of_empty_tables(spark):
    titles = spark.createDataFrame([], "name string")
    asked = spark.createDataFrame([(1, "!!"), (2, None)], "id int, title string")
    got = {r["id"]: (r["exact_count"], r["examples"]) for r in stats.exact_titles(titles, asked).collect()}
    assert got == {1: (0, []), 2: (0, [])}
    rows = spark.createDataFrame([], "pid int, owner string")
    assert stats.basket_owners(rows, "pid", "owner").count() == 0
    edges = spark.createDataFrame([], "a int, b int, weight bigint")
    assert tuple(graph.common_ground(edges, [1, 2]).first()) == (0, 0, 0.0)
    assert tuple(graph.collision_verdict(edges, 1, 2).first()) == (0, 0, "parallel_orbits")


def test_exact_titles_by_normal_form(spark):
    titles = spark.createDataFrame([("Road Trip",), ("road-trip!",), ("road trip",), ("Road Trip",), ("",), (None,)], "name string")
    asked = spark.createDataFrame([(1, "ROAD  trip"), (2, "other"), (3, "")], "id int, title string")
    got = {r["id"]: (r["exact_count"], r["examples"]) for r in stats.exact_titles(titles, asked).collect()}
    assert got == {1: (4, ["Road Trip", "road trip", "road-trip!"]), 2: (0, []), 3: (0, [])}


def test_bits_ids_and_first_names(spark):
    row = spark.createDataFrame([(5, "https://h/playlist/" + "a1" * 11 + "?x", "A , B")], "f int, u string, n string")
    got = row.select(matching.known_flags(F.col("f"), {"x": 1, "y": 2, "z": 4}), text.list_id(F.col("u")), text.first_name(F.col("n"))).first()
    assert tuple(got) == (["x", "z"], "a1" * 11, "A")


def test_soundtrack_route_by_brute_force(spark):
    """A beam that holds every route finds the cheapest of all; a narrow one a route of distinct ids."""
    from itertools import permutations

    rows = [(i, f"a{i % 3}", (i * 37 % 11) / 10, (i * 29 % 7) / 7, float(i * 13 % 5)) for i in range(8)]
    df = spark.createDataFrame([*rows, (3, "zz", 0.1, 0.1, -1.0), (99, "n", None, 0.5, 9.0)], "id long, artist string, energy double, valence double, fit double")
    curve, mood, best = vectors.CURVES["medium"], vectors.VALENCE["sleep"], max(r[4] for r in rows)

    def cost(route):
        total, before, met = 0.0, None, set()
        for (_, artist, e, valence, fit), target in zip(route, curve, strict=True):
            total = total + (0.18 * abs(valence - mood) + 0.14 * (1 - fit / max(best, 1.0))) + 0.52 * abs(e - target) + 0.16 * abs(e - (target if before is None else before)) + 0.12 * (artist in met)
            before = e
            met.add(artist)
        return total

    got = [r["id"] for r in vectors.soundtrack(spark, df, "lullaby", beam=100_000).orderBy("stage").collect()]
    by = {r[0]: r for r in rows}
    assert abs(cost([by[i] for i in got]) - min(cost(p) for p in permutations(rows, 6))) < 1e-9
    narrow = vectors.soundtrack(spark, df, "lullaby", beam=2).collect()
    assert len({r["id"] for r in narrow}) == 6 and {r["stage"]: r["role"] for r in narrow}[1] == "opener"
    assert vectors.soundtrack(spark, df.limit(5), "lullaby").collect() == []
