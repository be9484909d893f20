"""Summaries of a personal event history: plays with user, time, track, artist and milliseconds.

Where the thresholds are a matter of choice they are parameters: plays under SHORT milliseconds don't count as
taste, a gap of more than 30 minutes starts a session, an obsession is a track's densest fortnight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .stats import placed

#: Half a minute.
SHORT = 30_000


def totals(plays: DataFrame, short: int = SHORT) -> DataFrame:
    """Per user: all ms, counted plays, their artists, and active days."""
    long = F.col("ms") >= short
    return plays.groupBy("user_id").agg(
        F.sum("ms").alias("ms"),
        F.count_if(long).alias("plays"),
        F.countDistinct(F.when(long, F.col("artist"))).alias("artists"),
        F.countDistinct(F.to_date("ts")).alias("active_days"),
    )


def hours(plays: DataFrame) -> DataFrame:
    """ms and plays for each hour of weekdays and weekends, and the peak hour of each."""
    weekend = F.dayofweek("ts").isin(1, 7)
    out = plays.groupBy(weekend.alias("weekend"), F.hour("ts").alias("hour")).agg(F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("plays"))
    r = F.row_number().over(W.partitionBy("weekend").orderBy(F.desc("ms"), "hour"))
    return out.withColumn("peak", r == 1)


def top(plays: DataFrame, what: str, k: int = 10) -> DataFrame:
    """The k of a kind with most ms, with plays, the share of skips (null if none is known) and the busiest day."""
    per = plays.groupBy(what).agg(F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("plays"), F.round(F.avg((F.col("type") == "error").cast("int")), 4).alias("skip_rate"))
    best = per.orderBy(F.desc("ms"), what).limit(k)
    days = plays.groupBy(what, F.to_date("ts").alias("day")).agg(F.sum("ms").alias("day_ms"))
    busiest = days.join(F.broadcast(best.select(what)), what).groupBy(what).agg(F.min_by("day", F.struct(-F.col("day_ms"), "day")).alias("busiest_day"))
    return best.join(busiest, what)


def top_detail(plays: DataFrame, what: str, k: int = 10) -> DataFrame:
    """The k of a kind with most ms, with plays, the share of shuffled plays (null where none is known), the platform with most plays
    (ties by name), and ms an active day. plays: also shuffle and platform."""
    per = plays.groupBy(what).agg(
        F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("plays"), F.round(F.avg(F.col("shuffle").cast("int")), 4).alias("shuffle_rate"), F.countDistinct(F.to_date("ts")).alias("active_days")
    )
    best = per.orderBy(F.desc("ms"), what).limit(k)
    where = plays.join(F.broadcast(best.select(what)), what).where(F.col("platform").isNotNull()).groupBy(what, "platform").agg(F.count(F.lit(1)).alias("n"))
    first = where.groupBy(what).agg(F.min_by("platform", F.struct(-F.col("n"), "platform")).alias("platform"))
    return best.join(first, what, "left").withColumn("ms_per_day", F.round(F.col("ms") / F.col("active_days"), 1))


def session_summary(found: DataFrame) -> DataFrame:
    """Per user of sessions: how many, and the median and longest of their minutes."""
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.percentile("minutes", F.lit(0.5)).alias("median_minutes"), F.max("minutes").alias("longest_minutes"))


def sessions(plays: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """(user_id, session, start, start_hour, plays, ms, minutes): a gap of more than so many minutes starts a session."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") > F.lag("ts").over(w) + F.expr(f"interval {gap_minutes} minutes")
    numbered = plays.withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("session", F.sum("new").over(w))
    return numbered.groupBy("user_id", "session").agg(
        F.min("ts").alias("start"),
        F.hour(F.min("ts")).alias("start_hour"),
        F.count(F.lit(1)).alias("plays"),
        F.sum("ms").alias("ms"),
        F.floor(F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) / 60).cast("bigint").alias("minutes"),
    )


def artist_clock(plays: DataFrame, k: int = 12) -> DataFrame:
    """The k artists with most plays, with the circular mean of their hours and how focused they are (0 to 1)."""
    angle = F.hour("ts") * (2 * 3.141592653589793 / 24)
    per = plays.groupBy("artist").agg(F.count(F.lit(1)).alias("plays"), F.avg(F.sin(angle)).alias("s"), F.avg(F.cos(angle)).alias("c"))
    best = per.orderBy(F.desc("plays"), "artist").limit(k)
    hour = F.pmod(F.round(F.atan2("s", "c") * (24 / (2 * 3.141592653589793)), 3), F.lit(24.0))
    return best.select("artist", "plays", hour.alias("mean_hour"), F.round(F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")), 4).alias("focus"))


def obsessions(plays: DataFrame, days: int = 14, least: int = 2) -> DataFrame:
    """Per user and track with at least so many plays in one: the densest window of days, and whether no play came after it."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = plays.withColumn("at", seconds)
    w = W.partitionBy("user_id", "track").orderBy("at").rangeBetween(0, days * 86400)
    whole = W.partitionBy("user_id", "track")
    counted = rows.withColumn("peak_plays", F.count(F.lit(1)).over(w)).withColumn("last_at", F.max("at").over(whole))
    r = F.row_number().over(whole.orderBy(F.desc("peak_plays"), "at", "event_id"))
    best = counted.withColumn("r", r).where((F.col("r") == 1) & (F.col("peak_plays") >= least))
    return best.select("user_id", "track", "peak_plays", F.to_date("ts").alias("window_start"), (F.col("last_at") <= F.col("at") + days * 86400).alias("abandoned"))


def concentration(plays: DataFrame) -> DataFrame:
    """The Lorenz curve of artists by ms: rank, share of artists and of ms, with the artists that make half and the top ten's share."""
    per = plays.groupBy("artist").agg(F.sum("ms").alias("ms"))
    run = placed(per, [F.desc("ms"), F.col("artist")], "ms").withColumnRenamed("place", "rank")
    sums = per.select(F.sum("ms").alias("all_ms"), F.count(F.lit(1)).alias("n"))
    curve = run.crossJoin(F.broadcast(sums))
    half = curve.select(F.min(F.when(F.col("running") * 2 >= F.col("all_ms"), F.col("rank"))).alias("artists_for_half"), F.round(F.max(F.when(F.col("rank") <= 10, F.col("running") * 100.0 / F.col("all_ms"))), 2).alias("top10_share"))
    return curve.crossJoin(F.broadcast(half)).select(
        "artist", F.col("rank").cast("bigint").alias("rank"), F.round(F.col("rank") * 100.0 / F.col("n"), 2).alias("x"), F.round(F.col("running") * 100.0 / F.col("all_ms"), 2).alias("y"), F.col("artists_for_half").cast("bigint").alias("artists_for_half"), "top10_share"
    )


def discovery(plays: DataFrame, what: str = "track", unit: str = "week") -> DataFrame:
    """First-ever plays per user and unit of time (a week or a month, under its name); each user's first one is left out."""
    first = plays.groupBy("user_id", what).agg(F.min("ts").alias("first"))
    spans = first.select("user_id", F.to_date(F.date_trunc(unit, "first")).alias(unit))
    counted = spans.groupBy("user_id", unit).agg(F.count(F.lit(1)).alias("discovered"))
    return counted.withColumn("start", F.min(unit).over(W.partitionBy("user_id"))).where(F.col(unit) > F.col("start")).drop("start")


def drift(plays: DataFrame, k: int = 8, unit: str = "week") -> DataFrame:
    """ms per unit of time (a week or a month, under its name) of each of the k artists with most ms."""
    best = plays.groupBy("artist").agg(F.sum("ms").alias("total")).orderBy(F.desc("total"), "artist").limit(k)
    return plays.join(F.broadcast(best.select("artist")), "artist").groupBy("artist", F.to_date(F.date_trunc(unit, "ts")).alias(unit)).agg(F.sum("ms").alias("ms"))


def calendar(plays: DataFrame) -> DataFrame:
    """ms of each day from the first to the last, 0 on days without plays."""
    daily = plays.groupBy(F.to_date("ts").alias("day")).agg(F.sum("ms").alias("ms"))
    days = daily.select(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(daily, "day", "left").select("day", F.coalesce("ms", F.lit(0)).alias("ms"))


def chart_lead(plays: DataFrame, charted: DataFrame, max_lead: int = 60) -> DataFrame:
    """Per user and track: days from first play to first charting, for leads of at most max_lead either way.

    Tracks that charted before the user's history begins are left out. Each user's median lead goes along.
    """
    first = plays.groupBy("user_id", "track").agg(F.min(F.to_date("ts")).alias("first_play"))
    began = plays.groupBy("user_id").agg(F.min(F.to_date("ts")).alias("began"))
    lead = F.datediff("first_charted", "first_play")
    joined = first.join(charted, "track").join(began, "user_id").withColumn("lead_days", lead)
    kept = joined.where((F.col("first_charted") >= F.col("began")) & (F.abs("lead_days") <= max_lead))
    median = F.percentile("lead_days", F.lit(0.5)).over(W.partitionBy("user_id"))
    return kept.select("user_id", "track", "lead_days", (F.col("lead_days") > 0).alias("early"), median.alias("median_lead"))


def corpus_reference(plays: DataFrame, reach: DataFrame, k: int = 8) -> DataFrame:
    """The k artists with most ms with their reach in the corpus; one that the corpus lacks is marked absent, with null reach."""
    best = plays.groupBy("artist").agg(F.sum("ms").alias("ms")).orderBy(F.desc("ms"), "artist").limit(k)
    return best.join(reach, best["artist"] == reach["owner"], "left").select("artist", "ms", "basket_count", F.col("owner").isNull().alias("absent"))


def reference_summary(found: DataFrame) -> DataFrame:
    """One row for the artists of corpus_reference: how many, how many of them the corpus knows, and the mean reach of those, null without one."""
    return found.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("absent")).alias("matched"), F.round(F.avg("basket_count"), 3).alias("mean_reach"))


def neighbouring_regions(points: DataFrame, k: int = 14) -> DataFrame:
    """Distances between the centroids of the k largest regions, nearest first for each; k is fixed, so pairs are few."""
    centroids = points.groupBy("region").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "region").limit(k)
    other = centroids.select(F.col("region").alias("near"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = centroids.join(F.broadcast(other), F.col("region") != F.col("near")).withColumn("distance", F.round(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")), 4))
    return pairs.select("region", "near", "distance", F.row_number().over(W.partitionBy("region").orderBy("distance", "near")).cast("bigint").alias("rank"))
