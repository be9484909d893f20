"""Record matching, identity merging and patching of tables from secondary sources."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from ..session import ship, tasks
from .stats import ladder

# What the share of a list's tracks that a reference holds says, and of a list that is itself known.
REFERENCE_OVERLAPS = [(70, "high_reference_overlap"), (40, "moderate_reference_overlap"), (20, "some_reference_overlap"), (0, "low_reference_overlap")]
KNOWN_LIST = "known_editorial_playlist"

# The bit of each source in source_flags.
SOURCE_BITS = {"a": 1, "b": 4}


def ensure_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """df with a null column of the given type for each that it lacks."""
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in wanted.items() if c not in df.columns))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the given order; make it total, or which of equals stays is undefined."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def merge_identities(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer join where a's values win: key, columns, source_flags, match_method and an id by md5 of the key."""
    x, y = a.select(key, *columns, F.lit(True).alias("in_a")), b.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("in_b"))
    both = x.join(y, key, "full")
    flag = lambda side: F.when(F.col(f"in_{side}"), SOURCE_BITS[side]).otherwise(0)
    method = F.when(F.col("in_a") & F.col("in_b"), "a+b").when(F.col("in_a"), "a_only").otherwise("b_only")
    return both.select(
        key,
        *(F.coalesce(c, f"_{c}").alias(c) for c in columns),
        flag("a").bitwiseOR(flag("b")).cast("int").alias("source_flags"),
        method.alias("match_method"),
        F.md5(F.col(key).cast("string")).alias("canonical_id"),
    )


def patch(base: DataFrame, patches: DataFrame, key: str, columns: list[str], new_wins: bool = False) -> DataFrame:
    """base with nulls filled from patches by key; what is there stays unless new_wins. patches should have one row a key."""
    right = patches.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    first = lambda c: F.coalesce(f"_{c}", c) if new_wins else F.coalesce(c, f"_{c}")
    joined = base.join(right, key, "left")
    return joined.select(*(first(c).alias(c) if c in columns else F.col(c) for c in base.columns))


def blank(c: Column, placeholder: str | None = None) -> Column:
    """Whether a text is null, empty, only spaces, or the placeholder."""
    bare = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (bare == "") if placeholder is None else (bare == "") | (bare == placeholder)


def backfill(base: DataFrame, sources: list[DataFrame], key: str, column: str, placeholder: str) -> DataFrame:
    """base with blank or placeholder values of column taken from the first source that has one, and needs_metadata where none has."""
    out = base
    for i, source in enumerate(sources):
        new = f"_new{i}"
        out = out.join(source.select(key, F.col(column).alias(new)), key, "left")
        use = blank(F.col(column), placeholder) & ~blank(F.col(new), placeholder)
        out = out.withColumn(column, F.when(use, F.col(new)).otherwise(F.col(column))).drop(new)
    return out.withColumn("needs_metadata", blank(F.col(column), placeholder))


def append_new(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """base and the rows of batch whose key it lacks; columns that one side lacks are null."""
    return base.unionByName(batch.join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key): keys of either side that the other lacks."""
    n = tasks(left, right)
    a, b = (df.select(key).repartition(n, key).distinct() for df in (left, right))
    one = a.join(b, key, "left_anti").select(F.lit("left").alias("side"), key)
    return one.unionAll(b.join(a, key, "left_anti").select(F.lit("right").alias("side"), key))


def two_stage(wanted: DataFrame, exact: DataFrame, keys: list[str], fallback: str, value: str) -> DataFrame:
    """wanted matched by all keys, what is left by the fallback key alone with the value's mean there; match_type tells which."""
    once = exact.groupBy(*keys).agg(F.max(value).alias("value"))
    by_all = wanted.join(once, keys).withColumn("match_type", F.lit("exact"))
    rest = wanted.join(once, keys, "left_anti")
    means = exact.groupBy(fallback).agg(F.round(F.avg(value), 2).alias("value"))
    return by_all.unionByName(rest.join(means, fallback).withColumn("match_type", F.lit("fallback")))


def min_excluding(spine: DataFrame, key: str, value: str, excluded: DataFrame, on: str, low: int, high: int) -> DataFrame:
    """The least value per key of the rows that excluded does not have, if it lies between low and high."""
    kept = spine.join(excluded.select(on).distinct(), on, "left_anti").where(F.col(value).isNotNull())
    return kept.groupBy(key).agg(F.min(value).alias("first_year")).where(F.col("first_year").between(low, high))


#: Queries, and bytes of them, in one automaton.
QUERIES, QUERY_BYTES = 100_000, 64 << 20


def substring_hits(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, hits): the distinct texts that contain each query without regard to case; an empty query matches nothing.

    Texts are read once for as many queries as an automaton of bounded size holds: it finds all of them in one pass over a text.
    """
    spark = ship(texts.sparkSession)
    low = queries.select("query_id", F.lower("query").alias("query")).where("query <> ''")
    n, size = low.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("query")), F.lit(0))).first()
    parts = max(1, -(-n // QUERIES), -(-size // QUERY_BYTES))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((low, "query_id"), (texts, "id"))]
    rows = texts.select("id", F.lower("text").alias("low")).where("low IS NOT NULL")
    kind, found = to_arrow_type(low.schema["query_id"].dataType), None
    for i in range(parts):
        block = low.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).select("query_id", "query")
        asked = spark.sparkContext.broadcast([tuple(r) for r in block.collect()])
        hits = rows.mapInArrow(partial(_contained, asked, kind), f"query_id {kinds[0]}, id {kinds[1]}").groupBy("query_id").agg(F.countDistinct("id").alias("hits"))
        found = hits if found is None else found.unionAll(hits)
    return found


def _contained(asked, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, id) of the queries that each text contains."""
    import ahocorasick

    automaton, ids = ahocorasick.Automaton(), {}
    for query_id, query in asked.value:
        ids.setdefault(query, []).append(query_id)
    for query in ids:
        automaton.add_word(query, query)
    if not ids:
        return
    automaton.make_automaton()
    for batch in batches:
        pairs = [(q, i) for i, text in enumerate(batch.column(1).to_pylist()) for word in {w for _, w in automaton.iter(text)} for q in ids[word]]
        if pairs:
            where, at = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(where, kind), batch.column(0).take(pa.array(at))], ["query_id", "id"])


def forensics(submission: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: how many (title, artist) of a submission occur, as parts of title and artist, in a reference, and a verdict.

    An empty artist matches any. The submission is a short list and is broadcast.
    """
    on = F.expr("contains(r_title, title) AND (artist = '' OR contains(r_artist, artist))")
    total = submission.select(F.count(F.lit(1)).alias("total"))
    low = lambda *names: [F.lower(n).alias(n) for n in names]
    hits = reference.select(*low("r_title", "r_artist")).join(F.broadcast(submission.select("query_id", *low("title", "artist"))), on).agg(F.countDistinct("query_id").alias("hits"))
    pct = F.round(F.col("hits") * 100.0 / F.greatest("total", F.lit(1)), 0)
    return hits.crossJoin(total).select("hits", "total", pct.alias("pct")).withColumn("verdict", ladder(F.col("pct"), REFERENCE_OVERLAPS))


def known_or_forensics(list_id, known: DataFrame, submission: DataFrame, reference: DataFrame) -> DataFrame:
    """forensics of the submission, but for a list_id that known (list_id, num_tracks) holds: all of its tracks then count, without a look at them."""
    found = known.where(F.col("list_id") == F.lit(list_id)).select(F.max("num_tracks").cast("bigint").alias("n")).first()["n"]
    if found is None:
        return forensics(submission, reference)
    return known.sparkSession.range(1).select(*(F.lit(found).cast("bigint").alias(c) for c in ("hits", "total")), F.lit(100.0).alias("pct"), F.lit(KNOWN_LIST).alias("verdict"))


def resolve_pattern(names: DataFrame, wanted: str, by: str = "basket_count") -> DataFrame:
    """The row that a name means where names of any length are looked for: equal without regard to case, else the one with the
    greatest count in which wanted is found, read as a pattern; one that is no valid pattern is looked for as it stands."""
    import re

    low = wanted.lower()
    try:
        re.compile(low)
        found = F.lower("name").rlike(low)
    except re.error:
        found = F.contains(F.lower("name"), F.lit(low))
    rank = F.when(F.lower("name") == low, 0).when(found, 1)
    return names.withColumn("prio", rank).where("prio IS NOT NULL").orderBy("prio", F.desc(by), "name").limit(1).drop("prio")


def qualified_candidates(candidates: DataFrame, vocabulary: DataFrame, features: DataFrame, per_artist: int = 5) -> DataFrame:
    """(uri, title, artist, fit, energy, valence): candidates that the vocabulary knows by title and artist, without regard to case, and
    that have features; of each uri the row with the best fit (ties by artist, title), and of each artist the best per_artist.

    What a uri meets are the candidates of its title and artist, so of those that are alike in both the best is taken before they are joined: many
    candidates and many uris of one title make no pairs of each with each.
    """
    known = vocabulary.select(F.lower("title").alias("t"), F.lower("artist").alias("a"), "uri")
    first = keep_first(candidates.withColumns({"t": F.lower("title"), "a": F.lower("artist")}), ["t", "a"], [F.desc("fit"), F.col("artist"), F.col("title")])
    joined = known.join(first, ["t", "a"]).drop("t", "a").join(features, "uri")
    best = F.row_number().over(W.partitionBy("uri").orderBy(F.desc("fit"), "artist", "title"))
    once = joined.withColumn("r", best).where("r = 1")
    place = F.row_number().over(W.partitionBy("artist").orderBy(F.desc("fit"), "uri"))
    return once.withColumn("r", place).where(F.col("r") <= per_artist).select("uri", "title", "artist", "fit", "energy", "valence")


def resolve(names: DataFrame, wanted: str, by: str = "basket_count", least: int = 3, uri=None) -> DataFrame:
    """The row that a name means: of that uri where one is given and known, else equal without regard to case, else the one with
    the greatest count that contains it.

    Names shorter than least are looked for only as a whole.
    """
    low = F.lower("name")
    rank = F.when(low == wanted.lower(), 0).when(F.contains(low, F.lit(wanted.lower())) & F.lit(len(wanted) >= least), 1)
    if uri is not None:
        rank = F.when(F.col("uri") == F.lit(uri), -1).otherwise(rank)
    return names.withColumn("prio", rank).where("prio IS NOT NULL").orderBy("prio", F.desc(by), "name").limit(1).drop("prio")


def search(titles: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Titles that contain the query, those that begin with it first, then by popularity rank, each (title, artist) once.

    A query of fewer than two characters finds nothing.
    """
    low, q = F.lower("title"), query.strip().lower()
    hits = titles.where(F.contains(low, F.lit(q)) & F.lit(len(q) >= 2)).withColumn("prio", F.when(F.startswith(low, F.lit(q)), 0).otherwise(1))
    once = keep_first(hits, ["title", "artist"], [F.col("prio"), F.col("rank"), F.col("id")])
    return once.orderBy("prio", "rank", "id").limit(limit).select("id", "title", "artist", "rank", F.col("prio").cast("int").alias("prio"))


def passport(stats: DataFrame, title: str) -> DataFrame:
    """The items of that title without regard to case, most baskets first, and whether more than one owner has it."""
    found = stats.where(F.lower("title") == title.lower())
    owners = found.select(F.countDistinct("owner").alias("owners"))
    return found.crossJoin(F.broadcast(owners)).withColumn("ambiguous", F.col("owners") > 1).drop("owners")


def fill_empty_lists(base: DataFrame, source: DataFrame, name: str, column: str) -> DataFrame:
    """base with null or empty lists of column taken from source by name without regard to case; source's first row of a name counts."""
    once = keep_first(source.select(F.lower(name).alias("_key"), F.col(column).alias("_new")), ["_key"], [F.size("_new").desc(), F.col("_new")])
    joined = base.join(once, F.lower(base[name]) == once["_key"], "left")
    empty = F.size(F.coalesce(F.col(column), F.array().cast(base.schema[column].dataType))) == 0
    return joined.select(*(F.when(empty, F.coalesce("_new", column)).otherwise(F.col(column)).alias(column) if c == column else F.col(c) for c in base.columns))


def patch_dates(base: DataFrame, log: DataFrame, key: str, column: str) -> DataFrame:
    """base with dates from a log whose key has another type; both become whole numbers where they can, a new date wins, and its year goes along."""
    right = log.select(F.col(key).try_cast("double").try_cast("bigint").alias("_key"), F.col(column).alias("_new")).where("_key IS NOT NULL AND _new IS NOT NULL")
    once = right.groupBy("_key").agg(F.max("_new").alias("_new"))
    joined = base.join(once, base[key].try_cast("double").try_cast("bigint") == once["_key"], "left")
    value = F.coalesce("_new", column)
    return joined.select(*(value.alias(c) if c == column else F.col(c) for c in base.columns), F.year(F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))).alias("year"))


def two_hop(base: DataFrame, first: DataFrame, second: DataFrame, counts: DataFrame) -> DataFrame:
    """base (code, ...) with the recording that its code leads to over two tables, the smallest of several, and the recording's count, 0 without one.

    first: (code, recording); second: (recording, target); counts: (target, listen_count).
    """
    one = first.join(second, "recording").groupBy("code").agg(F.min("target").alias("target"))
    return base.join(one, "code", "left").join(counts, "target", "left").select(*base.columns, "target", F.coalesce("listen_count", F.lit(0)).alias("listen_count"))


def by_id_else_name(rows: DataFrame, lookup: DataFrame, value: str) -> DataFrame:
    """rows (id, title, artist) with lookup's value for the id, else for title and artist without regard to case and space at the ends."""
    norm = lambda c: F.lower(F.trim(c))
    ids = keep_first(lookup, ["id"], [F.col(value)]).select("id", F.col(value).alias("_by_id"))
    keyed = lookup.select(norm("title").alias("_t"), norm("artist").alias("_a"), F.col(value).alias("_by_name"), F.col("id").alias("_i"))
    names = keep_first(keyed, ["_t", "_a"], [F.col("_i"), F.col("_by_name")]).drop("_i")
    joined = rows.join(ids, "id", "left").join(names, (norm(rows["title"]) == F.col("_t")) & (norm(rows["artist"]) == F.col("_a")), "left")
    return joined.select(*rows.columns, F.coalesce("_by_id", "_by_name").alias(value))


def standing(full: DataFrame, slim: DataFrame, wanted: str, least: int = 3) -> DataFrame:
    """(name, basket_count, rank, detail_level): the row of full that a name means, as full, else that of slim, the wider and plainer
    ranking, as rank_only: equal without regard to case, else the best-ranked that contains it. No rows where neither knows it."""
    names = ["name", "basket_count", "rank"]
    best = resolve(full, wanted, "basket_count", least).select(*names, F.lit("full").alias("detail_level"), F.lit(0).alias("_o"))
    low = F.lower("name")
    prio = F.when(low == wanted.lower(), 0).when(F.contains(low, F.lit(wanted.lower())) & F.lit(len(wanted) >= least), 1)
    plain = slim.withColumn("_p", prio).where("_p IS NOT NULL").orderBy("_p", "rank", "name").limit(1).select(*names, F.lit("rank_only").alias("detail_level"), F.lit(1).alias("_o"))
    return best.unionAll(plain).orderBy("_o").limit(1).drop("_o")


def fill_by_map(rows: DataFrame, mapping: DataFrame, key: str, column: str) -> DataFrame:
    """rows with null values of column taken from mapping (key, column); of a key's values the least counts."""
    once = mapping.where(F.col(column).isNotNull()).groupBy(key).agg(F.min(column).alias("_new"))
    return rows.join(once, key, "left").select(*(F.coalesce(c, "_new").alias(c) if c == column else F.col(c) for c in rows.columns))


def with_first_tag(vocabulary: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """vocabulary with top_tag, the first of its key's tags (key, tags, rank); of a key's rows the one of the least rank counts, null without tags."""
    once = tags.groupBy(key).agg(F.min_by("tags", F.struct("rank", "tags")).alias("_tags"))
    return vocabulary.join(once, key, "left").withColumn("top_tag", F.get("_tags", F.lit(0))).drop("_tags")


def known_flags(flags: Column, names: dict[str, int]) -> Column:
    """The names of the bits that are set, in order of their bits."""
    each = F.array(*(F.when(flags.bitwiseAND(F.lit(bit)) != 0, name) for name, bit in sorted(names.items(), key=lambda x: x[1])))
    return F.array_compact(each)


def best_of_sources(sources: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """The rows of several sources, with columns that one lacks as null, and of a key the first in the given order."""
    whole = sources[0]
    for s in sources[1:]:
        whole = whole.unionByName(s, allowMissingColumns=True)
    return keep_first(whole, [key], order)


def with_images(names: DataFrame, images: DataFrame, most: int = 50) -> DataFrame:
    """(name, image_url, placeholder) of at most so many names: the known image, or the name's initials to show instead."""
    from ..functions.text import initials

    known = images.groupBy(F.lower("name").alias("_key")).agg(F.min("image_url").alias("image_url"))
    some = names.select("name").distinct().orderBy("name").limit(most)
    return some.join(known, F.lower("name") == F.col("_key"), "left").select("name", "image_url", F.when(F.col("image_url").isNull(), initials(F.col("name"))).alias("placeholder"))
