"""Chart files that come in several runs against the same files read at once."""

from __future__ import annotations

from basketry.sources import keyed, readers
from basketry.streaming import charts


def test_files_in_three_runs_give_the_rows_of_one(spark, tmp_path):
    folder, schema = tmp_path / "charts", "rank int, uri string"
    folder.mkdir()
    run = lambda: charts.keep_charts(spark, str(folder), schema, str(tmp_path / "table"), ["uri"], str(tmp_path / "progress"))
    put = lambda day, n, first=1: (folder / f"top-{day}.csv").write_text("rank,uri\n" + "".join(f"{i},u{i}\n" for i in range(first, first + n)))
    put("2020-01-02", 12)
    put("2020-01-09", 15)
    (folder / "top-2020-01-16.csv").write_text("<html>\n<body>\n")
    run()
    version = keyed.manifest(spark, str(tmp_path / "table"))["version"]
    run()
    assert keyed.manifest(spark, str(tmp_path / "table"))["version"] == version
    put("2020-01-23", 11, 5)
    put("undated", 20)
    run()
    want = {tuple(r) for r in readers.dated_charts(spark, str(folder), schema).where("date IS NOT NULL").select("rank", "uri", "date").collect()}
    got = [tuple(r) for r in charts.charts(spark, str(tmp_path / "table")).select("rank", "uri", "date").collect()]
    assert len(got) == len(set(got)) == 38 and set(got) == want
    # A corrected file for a date takes the place of that date's rows of the same key.
    (folder / "again-2020-01-02.csv").write_text("rank,uri\n" + "".join(f"{i + 100},u{i}\n" for i in range(1, 13)))
    run()
    assert {r["rank"] for r in charts.charts(spark, str(tmp_path / "table")).where("date = '2020-01-02'").collect()} == set(range(101, 113))
