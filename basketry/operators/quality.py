"""Data-quality audits: coverage, duplicates, collisions, guards and full-text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and for each column how many hold a value and what share."""
    whole = F.greatest(F.count(F.lit(1)), F.lit(1))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count(c).alias(f"has_{c}") for c in columns),
        *(F.round(F.count(c) * 100.0 / whole, 2).alias(f"pct_{c}") for c in columns),
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that come more than once, and how often; each null counts as a value."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def collisions(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that stand for more than one value."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("values"), F.count(F.lit(1)).alias("rows")).where("values > 1")


def flag_report(df: DataFrame, flag: str, keys: list[str], required: list[str]) -> DataFrame:
    """Per value of flag: rows, rows whose keys come again anywhere, and nulls of each required column."""
    again = duplicates(df, keys).select(*(F.col(k).alias(f"_{k}") for k in keys), F.lit(True).alias("_again"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(again, on, "left").groupBy(flag).agg(
        F.count(F.lit(1)).alias("rows"), F.count("_again").alias("repeated"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required)
    )


def blank_guard(df: DataFrame, column: str, most: float = 0.05) -> DataFrame:
    """One row: rows, blank values, their share, and whether that is within bounds."""
    empty = F.length(F.trim(F.coalesce(F.col(column), F.lit("")))) == 0
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(empty).alias("blank"))
    return out.withColumn("blank_share", F.round(F.col("blank") * 1.0 / F.greatest("rows", F.lit(1)), 4)).withColumn("ok", F.col("blank_share") <= most)


def require_filled(df: DataFrame, column: str, most: float = 0.05) -> DataFrame:
    """df, or a ValueError if too many values of column are blank."""
    if not blank_guard(df, column, most).first()["ok"]:
        raise ValueError(f"more than {most:.0%} of {column} is blank")
    return df


def audit(df: DataFrame, by: str, value: str, flag: str) -> DataFrame:
    """Per group: rows, flagged rows, mean, least and greatest value."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(flag).alias("flagged"), F.round(F.avg(value), 3).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def inverted_index(texts: DataFrame) -> DataFrame:
    """(token, id, n): postings of ASCII-folded lower-case words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9]+"), F.lit(0))
    return texts.select("id", F.explode(words).alias("token")).groupBy("token", "id").agg(F.count(F.lit(1)).alias("n"))


def search(index: DataFrame, ranks: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The k ids that have all words of the query, by how often they have them, then by popularity rank."""
    import re

    words = sorted(set(re.findall(r"[a-z0-9]+", query.lower())))
    hits = index.where(F.col("token").isin(words)).groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("score"))
    return hits.where(F.col("words") == len(words)).join(ranks, "id", "left").orderBy(F.desc("score"), F.col("rank").asc_nulls_last(), "id").limit(k).select("id", "score", "rank")


def sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows without replacement, the same for the same key, seed and rows: those first by hash (ties by key)."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k)
