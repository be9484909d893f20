"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, details, files, graphs, history, matches, merges, reach, round_trips, vectors_quality


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for part in (reach, graphs, matches, merges, archives, history, vectors_quality, files, details, round_trips):
        out |= part.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for part in (reach, graphs, matches, merges, archives, history, vectors_quality, files, details, round_trips):
        out |= part.ORACLE
    return out
