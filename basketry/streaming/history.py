"""Streaming twins of sessions and weekly charts, beyond what the batch operators need: late plays are bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(plays: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, plays, ms) of sessions that a gap of more than gap ends; end is the last play plus the gap."""
    stamped = plays.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = stamped.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("plays"), F.sum("ms").alias("ms"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "plays", "ms")


def weekly_counts(plays: DataFrame, late: str = "1 day") -> DataFrame:
    """(week, track, plays, ms): plays of each track in weeks that begin on Monday."""
    stamped = plays.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = stamped.groupBy(F.window("ts", "7 days", startTime="4 days").alias("w"), "track").agg(F.count(F.lit(1)).alias("plays"), F.sum("ms").alias("ms"))
    return out.select(F.to_date("w.start").alias("week"), "track", "plays", "ms")
