"""Readers: headerless dumps, dated chart files, multi-row headers, nested JSON, archives and list pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

PLAYLIST_SLICE = """playlists array<struct<pid:int, name:string, collaborative:string, modified_at:bigint, num_tracks:int, num_albums:int,
    num_followers:int, num_edits:int, duration_ms:bigint, num_artists:int, description:string,
    tracks:array<struct<pos:int, track_uri:string, track_name:string, artist_uri:string, artist_name:string, album_uri:string, album_name:string, duration_ms:int>>>>"""
ARCHIVE = """name string, description string, url string, date_first_scraped string,
    tracks array<struct<url:string, name:string, duration_ms:bigint, added_at:string, removed_at:string, artists:array<struct<name:string, url:string>>, album:struct<name:string, url:string>>>"""


def columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Some columns of Parquet files; the scan reads no others, and filters put on the result reach it."""
    return spark.read.parquet(path).select(*names)


def dump(spark: SparkSession, path: str, schema: str, keep: list[str] | None = None) -> DataFrame:
    """A tab-separated dump without header or quotes, \\N for null; short rows are padded and unreadable values are null."""
    df = spark.read.csv(path, schema=schema, sep="\t", header=False, quote="", escape="", nullValue="\\N", mode="PERMISSIVE")
    return df.select(*keep) if keep else df


def guarded_lines(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Lines (compressed ones too) with exactly the schema's fields, all of which can be cast; other lines are passed over."""
    fields = StructType.fromDDL(schema).fields
    parts = spark.read.text(path).select(F.split("value", sep, -1).alias("p")).where(F.size("p") == len(fields))
    cast = parts.select(*(F.get("p", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)))
    return cast.where(" AND ".join(f"`{f.name}` IS NOT NULL" for f in fields))


def dated_charts(spark: SparkSession, folder: str, schema: str, least: int = 10) -> DataFrame:
    """All CSV files of a folder with the date in their names as column date; files with fewer than least good rows are passed over.

    Pages of HTML saved as CSV have no row whose first column can be read, so they fall to the same rule.
    """
    first = StructType.fromDDL(schema).names[0]
    df = spark.read.csv(f"{folder}/*.csv", schema=schema, header=True, mode="PERMISSIVE").withColumn("_file", F.col("_metadata.file_name"))
    good = df.where(F.col(first).isNotNull())
    sizes = good.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return good.join(sizes, "_file", "left_semi").withColumn("date", F.regexp_extract("_file", r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date")).drop("_file")


def multi_header(spark: SparkSession, path: str, rows: int = 2) -> DataFrame:
    """A CSV file whose first rows are its header, flattened to a_b names; an empty cell takes the one on its left in upper rows."""
    lines = [r["value"] for r in spark.read.text(path).limit(rows).collect()]
    head = [line.split(",") for line in lines]
    for row in head[:-1]:
        for i in range(1, len(row)):
            row[i] = row[i] or row[i - 1]
    width = max(map(len, head))
    names = ["_".join(x for x in (row[i].strip() if i < len(row) else "" for row in head) if x) or f"c{i}" for i in range(width)]
    body = spark.read.text(path).where(~F.col("value").isin(lines))
    return body.select(F.from_csv("value", ", ".join(f"`_{i}` string" for i in range(width))).alias("r")).select("r.*").toDF(*names)


def playlist_slices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(playlists, tracks, playlist_tracks) of JSON slices; of a track that comes often the row of the lowest playlist and place counts."""
    lists = spark.read.json(path, schema=PLAYLIST_SLICE, multiLine=True).select(F.explode("playlists").alias("p")).select("p.*")
    playlists = lists.drop("tracks").withColumn("collaborative", F.lower("collaborative") == "true")
    rows = lists.select("pid", F.explode("tracks").alias("t")).select("pid", "t.*")
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("track_uri").orderBy("pid", "pos"))).where("r = 1")
    return playlists, first.drop("r", "pid", "pos"), rows.select("pid", "track_uri", F.col("pos").cast("smallint").alias("pos"))


def _uri(url: F.Column) -> F.Column:
    found = F.concat_ws(":", F.regexp_extract(url, r"//[^/]*?([^./]+)\.[^./]+/", 1), F.regexp_extract(url, r"/([^/]+)/[^/?#]+[^/]*$", 1), F.regexp_extract(url, r"/([^/?#]+)[^/]*$", 1))
    return F.when(found != "::", found)


def archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(playlists, tracks) of archive JSON files, one a playlist; files that can't be read are passed over, and the first artist stands for all."""
    files = spark.read.json(path, schema=ARCHIVE, multiLine=True, mode="PERMISSIVE").withColumn("playlist_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json", 1))
    good = files.where(F.col("name").isNotNull() & F.col("tracks").isNotNull())
    playlists = good.select("playlist_id", "name", "description", "url", "date_first_scraped", F.size("tracks").cast("bigint").alias("num_tracks"))
    rows = good.select("playlist_id", F.explode("tracks").alias("t"))
    artist = F.try_element_at("t.artists", F.lit(1))
    tracks = rows.select(
        "playlist_id",
        _uri(F.col("t.url")).alias("track_uri"),
        F.col("t.name").alias("track_name"),
        artist["name"].alias("artist_name"),
        _uri(artist["url"]).alias("artist_uri"),
        F.col("t.album.name").alias("album_name"),
        _uri(F.col("t.album.url")).alias("album_uri"),
        F.col("t.duration_ms").alias("duration_ms"),
        F.regexp_replace("t.added_at", r"\*", "").alias("date_added"),
        F.col("t.removed_at").alias("date_removed"),
        F.coalesce(F.contains("t.added_at", F.lit("*")), F.lit(False)).alias("date_added_asterisk"),
    )
    return playlists, without_placeholders(tracks)


def without_placeholders(tracks: DataFrame) -> DataFrame:
    """Without rows that name no track: no uri, or no title under a blank or placeholder artist."""
    bare = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    empty = (bare("track_uri") == "") | (bare("artist_name").isin("", "artist") & (bare("track_name") == ""))
    return tracks.where(~empty)


def _pairs(c: str, pattern: str) -> F.Column:
    """The pattern's two groups at each match, as an array of (a, b)."""
    a, b = (F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.transform(a, lambda x, i: F.struct(x.alias("a"), F.get(b, i).alias("b")))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, label): the links of list items in page order, with the common character references decoded."""
    item = r'<li>\s*<a href="([^"]*)">([^<]*)</a>'
    rows = pages.where(F.col("html").isNotNull()).select("page_id", F.posexplode(_pairs("html", item)).alias("pos", "x"))
    label = F.col("x.b")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        label = F.replace(label, F.lit(ref), F.lit(char))
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.col("x.a").alias("href"), label.alias("label"))


def track_list(pages: DataFrame) -> DataFrame:
    """(page_id, pos, title, artist): the rows of a list page, a title in h3 and an artist in h4 that may begin with a mark span."""
    row = r"(?s)<h3[^>]*>(.*?)</h3>.*?<h4[^>]*>(?:<span[^>]*>.*?</span>)?(.*?)</h4>"
    rows = pages.select("page_id", F.posexplode(_pairs("html", row)).alias("pos", "x"))
    plain = lambda c: F.replace(F.trim(F.regexp_replace(c, "<[^>]+>", "")), F.lit("&amp;"), F.lit("&"))
    return rows.select("page_id", "pos", plain(F.col("x.a")).alias("title"), plain(F.col("x.b")).alias("artist"))


def matrix(spark: SparkSession, path: str, block: int = 25_000) -> DataFrame:
    """(idx, vector): the rows of a .npy matrix in a folder that executors can open, mapped block by block and never loaded whole."""
    import numpy as np
    import pyarrow as pa

    n, width = np.load(path, mmap_mode="r").shape

    def run(batches):
        rows = np.load(path, mmap_mode="r")
        for batch in batches:
            for i in batch.column(0).to_pylist():
                part = np.ascontiguousarray(rows[i * block : (i + 1) * block], np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i * block, i * block + len(part))), vectors], ["idx", "vector"])

    return spark.range(-(-n // block)).mapInArrow(run, "idx long, vector array<float>")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a JSON manifest; no rows where the file holds none."""
    return spark.read.json(path, multiLine=True, mode="DROPMALFORMED")
