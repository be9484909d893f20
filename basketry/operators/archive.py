"""Archive lifetimes, eras, charts and title moods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text

# What is no music, by playlist name and by artist name, without regard to case.
NONMUSIC_PLAYLIST = r"learn\b|language|\blesson|for beginners|audiobook|\bpodcast|meditation|white noise|\basmr\b|sleep sounds|rain sounds|nature sounds|bedtime|sermon|scripture|the great courses|comedy|stand[- ]?up|spoken word"
NONMUSIC_ARTIST = r"publications|\blimited\b|\bltd\b|audiobook|\breadings?\b|the great courses|\blectures?\b|monty python|chomsky"

# The keywords of each mood and those that contradict it.
MOODS = {
    "sad": ["sad", "sadness"],
    "happy": ["happy", "happiness", "joy"],
    "angry": ["angry", "anger", "rage"],
    "heartbreak": ["heartbreak", "heartbroken", "breakup"],
    "anxious": ["anxious", "anxiety", "panic", "nervous"],
    "lonely": ["lonely", "loneliness", "alone"],
    "gym": ["gym", "workout", "work out"],
    "party": ["party", "partying"],
    "study": ["study", "studying", "focus"],
    "sleep": ["sleep", "sleeping", "bedtime"],
    "chill": ["chill", "chilling", "relax"],
}
CONTRARY = {
    "sad": ["gym", "workout", "hype", "party", "banger", "pump", "energy"],
    "happy": ["sad", "cry", "heartbreak", "miss", "broken", "pain"],
    "angry": ["calm", "chill", "sleep", "soft", "peace"],
    "heartbreak": ["party", "dance", "happy", "celebration", "love"],
    "anxious": ["calm", "chill", "sleep", "focus", "relax"],
    "lonely": ["party", "friends", "social", "together", "dance"],
    "gym": ["sleep", "sad", "cry", "study", "focus", "calm", "ambient"],
    "party": ["sleep", "study", "focus", "calm", "sad", "cry", "ambient"],
    "study": ["party", "hype", "banger", "turn up", "dance", "club"],
    "sleep": ["gym", "workout", "hype", "party", "dance", "energy", "pump"],
    "chill": ["gym", "hype", "party", "banger", "pump", "energy", "intense"],
}

# Eras by name; nothing after the corpus's end has a count to be ranked by.
ERAS = {"60s": (1960, 1969), "70s": (1970, 1979), "80s": (1980, 1989), "90s": (1990, 1999), "1960s": (1960, 1969), "1970s": (1970, 1979), "1980s": (1980, 1989), "1990s": (1990, 1999), "2000s": (2000, 2009), "2010s": (2010, 2017), "2020s": (2020, 2029)}
FIRST_YEAR, LAST_YEAR = 1940, 2017


def era(name: str, last: int = LAST_YEAR) -> tuple[int, int] | None:
    """The years of an era's name or of a four-digit year; None for others, ValueError past the corpus's end."""
    found = ERAS.get(name.strip().lower())
    if found is None and name.strip().isdigit() and len(name.strip()) == 4:
        found = (int(name), int(name))
    if found and found[0] > last:
        raise ValueError("the era lies outside the corpus")
    return found


def music_only(df: DataFrame, artist: str | None = None, playlist: str | None = None) -> DataFrame:
    """Without the rows whose artist's or playlist's name says that they are no music."""
    for c, pattern in ((artist, NONMUSIC_ARTIST), (playlist, NONMUSIC_PLAYLIST)):
        if c:
            df = df.where(~F.coalesce(F.col(c), F.lit("")).rlike(f"(?i){pattern}"))
    return df


def lifetimes(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Removed rows with their playlist's name and the days they stayed, 0 where the dates are out of order; dates as ISO text."""
    stay = F.greatest(F.datediff("removed", "added"), F.lit(0))
    return rows.where(F.col("removed").isNotNull()).join(names, key, "left").withColumn("days_on", stay).withColumn(
        "date_added", F.date_format("added", "yyyy-MM-dd")
    ).withColumn("date_removed", F.date_format("removed", "yyyy-MM-dd")).drop("added", "removed")


def forgotten(removed: DataFrame, charts: DataFrame, key: str, as_of: str, min_days: int, limit: int) -> DataFrame:
    """The limit longest stays of at least min_days that ended over a year before as_of, with chart fields where there are any."""
    old = removed.where((F.col("days_on") >= min_days) & (F.to_date("date_removed") < F.date_sub(F.lit(as_of).cast("date"), 365)))
    best = old.orderBy(F.desc("days_on"), F.desc("date_removed"), "id").limit(limit)
    return best.join(charts, key, "left")


def removed_list(removed: DataFrame, by: str, limit: int, ties: list[str]) -> DataFrame:
    """The limit removed rows that stayed longest (by longest) or went last (by recent; any other word too), nulls last, ties by the given columns."""
    first = F.desc_nulls_last("days_on" if by == "longest" else "date_removed")
    return removed.orderBy(first, *ties).limit(limit)


def named_capsule(rows: DataFrame, names: DataFrame, wanted: str) -> DataFrame:
    """Rows (playlist, added, ...) with a known date in the playlists (playlist, name) whose name contains wanted without regard to
    case, without those that are no music. This is what a name that era does not know stands for."""
    found = music_only(names.where(F.contains(F.lower("name"), F.lit(wanted.strip().lower()))), None, "name")
    return rows.where(F.col("added").isNotNull()).join(found, "playlist")


def era_tracks(spine: DataFrame, years: DataFrame, more_years: DataFrame, last: int) -> DataFrame:
    """spine (id, ...) with release_year from years, else more_years, and year_source; years past last are dropped, not clamped."""
    joined = spine.join(years.select("id", F.col("year").alias("y1")), "id", "left").join(more_years.select("id", F.col("year").alias("y2")), "id", "left")
    out = joined.withColumn("release_year", F.coalesce("y1", "y2")).withColumn("year_source", F.when(F.col("y1").isNotNull(), "first").when(F.col("y2").isNotNull(), "second"))
    return out.where(F.col("release_year") <= last).drop("y1", "y2")


def in_era(tracks: DataFrame, low: int, high: int, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    return tracks.where(F.col("release_year").between(max(low, first), min(high, last)))


def chart_history(rows: DataFrame) -> DataFrame:
    """Per track: peak, weeks, most and all of its streams, first and last week, and the first week at the peak."""
    return rows.groupBy("track").agg(
        F.min_by("name", F.struct("week", "rank")).alias("name"),
        F.min("rank").alias("chart_peak"),
        F.count(F.lit(1)).alias("total_weeks"),
        F.max("streams").alias("max_streams_week"),
        F.sum("streams").alias("total_streams"),
        F.min("week").alias("first_charted"),
        F.max("week").alias("last_charted"),
        F.min_by("week", F.struct("rank", "week")).alias("peak_date"),
    )


def chart_years(charts: DataFrame, spine: DataFrame) -> DataFrame:
    """charts (track, ...) with the release_year that the spine (track, release_year as text) has for the track; null where it has none or no number."""
    years = spine.select("track", F.expr("try_cast(release_year AS int)").alias("release_year")).groupBy("track").agg(F.min("release_year").alias("release_year"))
    return charts.join(years, "track", "left")


def number_ones(history: DataFrame, low: int, high: int, k: int = 10) -> DataFrame:
    """The k number ones of the years with most streams in a week, each name once."""
    ones = history.where((F.col("chart_peak") == 1) & F.year("peak_date").between(low, high))
    key = F.lower(F.trim("name"))
    r = F.row_number().over(W.partitionBy(key).orderBy(F.desc("max_streams_week"), "track"))
    return ones.withColumn("r", r).where("r = 1").orderBy(F.desc("max_streams_week"), "track").limit(k).select("track", "name", "max_streams_week", "peak_date")


def mood_flags(mood: str, name: Column) -> tuple[Column, Column]:
    """Whether a title has the mood's keywords, and whether it has contrary ones, as whole words.

    An unknown mood is its own keyword; what contradicts it depends on whether it is a sad one.
    """
    keys = MOODS.get(mood, [mood])
    against = CONTRARY.get(mood, ["party", "hype", "gym"] if "sad" in mood else ["sad", "cry", "heartbreak"])
    low = F.lower(name)
    return low.rlike(text.bounded(keys)), low.rlike(text.bounded(against))


def mood_map(titles: DataFrame, categories: dict[str, list[str]], k: int = 8) -> DataFrame:
    """Per category: matching titles, their share, and the k words that are most frequent in them; categories may overlap.

    total_matched counts titles with any category, assignments those of all categories. Words of more than
    three characters count, in lower case without marks at their ends; ties go by word.
    """
    named = titles.where(F.col("name").isNotNull())
    flags = [F.lower("name").rlike(text.bounded(words)).alias(c) for c, words in categories.items()]
    marked = named.select(F.lower("name").alias("name"), *flags)
    hit = F.filter(F.array(*(F.when(F.col(c), F.lit(c)) for c in categories)), lambda x: x.isNotNull())
    held = marked.select("name", hit.alias("hit"))
    total = held.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("hit") > 0).alias("total_matched"), F.sum(F.size("hit")).alias("assignments"))
    rows = held.select("name", F.explode("hit").alias("category"))
    sizes = rows.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    words = rows.select("category", F.explode(F.split("name", r"\s+")).alias("w")).select("category", F.regexp_replace("w", r"^[^a-z0-9]+|[^a-z0-9]+$", "").alias("w")).where(F.length("w") > 3)
    counts = words.groupBy("category", "w").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("r", F.row_number().over(W.partitionBy("category").orderBy(F.desc("n"), "w"))).where(F.col("r") <= k)
    terms = best.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("top_terms"))
    return sizes.join(terms, "category", "left").crossJoin(F.broadcast(total)).select(
        "category", "count", F.round(F.col("count") * 100.0 / F.col("total"), 2).alias("pct"), "top_terms", "total_matched", "assignments"
    )


def related_terms(terms: DataFrame, term: str, k: int = 8) -> DataFrame:
    """A term (hyphens as spaces, else as it is) and the k most frequent others of its theme."""
    own = terms.where(F.col("term").isin(term.replace("-", " "), term)).orderBy(F.col("term") != term.replace("-", " ")).limit(1).select(F.col("term").alias("of"), F.col("theme").alias("t"))
    return terms.join(F.broadcast(own), (F.col("theme") == F.col("t")) & (F.col("term") != F.col("of"))).orderBy(F.desc("count"), "term").limit(k).select("of", "term", "theme", "count")


def habitat_scores(tags: DataFrame, vocabulary: dict[str, list[str]], full: float = 40.0) -> DataFrame:
    """(owner, context, score): how much of a context's words an owner's tags have; 15 per cent of them give the full score."""
    out = []
    for c, words in vocabulary.items():
        n = F.size(F.array_intersect(F.array_distinct(F.transform("tags", lambda x: F.lower(x))), F.array(*map(F.lit, words))))
        out.append(F.struct(F.lit(c).alias("context"), F.round(F.least(n / max(0.15 * len(words), 1), F.lit(1.0)) * full, 2).alias("score")))
    return tags.select("owner", F.explode(F.array(*out)).alias("s")).select("owner", "s.context", "s.score")


def tag_only(own: DataFrame, scores: DataFrame, listeners: DataFrame, per: int = 1000) -> DataFrame:
    """(owner, basket_count, context, pct): owners that own (owner) lacks, without regard to case, and that have any tag score; a
    basket stands for per of their listeners (owner, listeners)."""
    known = own.select(F.lower("owner").alias("_low")).distinct()
    fresh = scores.join(known, F.lower("owner") == F.col("_low"), "left_anti")
    some = fresh.where("score > 0").select("owner").distinct()
    count = F.floor(F.coalesce("listeners", F.lit(0)) / per).cast("bigint")
    return fresh.join(some, "owner", "left_semi").join(listeners, "owner", "left").select("owner", count.alias("basket_count"), "context", F.col("score").alias("pct"))


def blend_scores(own: DataFrame, tags: DataFrame, weight: float = 0.7) -> DataFrame:
    """own (owner, context, pct) with tag scores blended in where there are any; owners with tags alone come with those."""
    both = own.join(tags, ["owner", "context"], "full")
    pct = F.when(F.col("pct").isNull(), F.col("score")).when(F.coalesce("score", F.lit(0.0)) > 0, weight * F.col("pct") + (1 - weight) * F.col("score")).otherwise(F.col("pct"))
    return both.select("owner", "context", F.round(pct, 2).alias("pct"))
