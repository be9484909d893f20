"""Reach, rank, top-list and distribution statistics of items and owners over baskets.

Windows without a partition run only over counts of values, terms or tasks, never over facts or owners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text
from ..session import checkpoint_dir, tasks

# The standing of an owner by its percentile.
STANDINGS = [(90, "top_decile"), (75, "high_reach"), (50, "above_median_reach"), (0, "focused_reach")]
#: The rank of what no ranking knows, the greatest int.
UNRANKED = 2147483647


def ladder(value: Column, steps: list[tuple[float, str]]) -> Column:
    """The name of the first step that value reaches; the last step's name for all others, null too."""
    out = F.lit(steps[-1][1])
    for least, name in reversed(steps[:-1]):
        out = F.when(value >= least, name).otherwise(out)
    return out


def placed(rows: DataFrame, order: list[Column], total: str | None = None) -> DataFrame:
    """rows with place, counted from 1 in the given order (make it total), and running, the sum of column total up to there.

    Rows are sorted by range over all tasks and held, so that no task takes them all; what runs over them at one place are
    the tasks' own counts and sums alone.
    """
    checkpoint_dir(rows.sparkSession)
    held = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    held = held.withColumn("_part", F.shiftright("_at", 33))
    sums = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), *([F.sum(total).alias("_sum")] if total else []))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums.columns[1:]))
    out = held.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_rows_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    if total:
        within = F.sum(total).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow))
        out = out.withColumn("running", F.col("_sum_before") + within)
    return out.select(*rows.columns, "place", *(["running"] if total else []))


def rounded(value: Column, digits: int) -> Column:
    """A double rounded as SQL's round() does it, on its product with the power of ten; Spark rounds the digits that it would print."""
    return F.round(value * float(10**digits)) / float(10**digits)


def share(part: Column, whole: Column, digits: int) -> Column:
    """part / whole as a percentage; integers first, so that both engines round the same value."""
    return rounded(part * 100.0 / whole, digits)


def ordered_list(order: list[Column], value: str, k: int | None = None) -> Column:
    """Aggregate: the values in the given order (plain columns ascending), at most k."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    values = F.transform(rows, lambda r: r["_v"])
    return F.slice(values, 1, k) if k else values


def reach(joined: DataFrame, owner: str, basket: str) -> DataFrame:
    """(owner, basket_count): distinct baskets per owner; null owners are left out."""
    return joined.where(F.col(owner).isNotNull()).groupBy(F.col(owner).alias("owner")).agg(F.countDistinct(basket).alias("basket_count"))


def reach_rank(joined: DataFrame, owner: str, basket: str) -> DataFrame:
    """Distinct baskets per owner, their share of all baskets, and the rank (ties by owner)."""
    total = joined.select(F.countDistinct(basket).alias("total"))
    ranked = placed(reach(joined, owner, basket), [F.desc("basket_count"), F.col("owner")])
    return ranked.crossJoin(F.broadcast(total)).select("owner", "basket_count", share(F.col("basket_count"), F.col("total"), 3).alias("basket_pct"), F.col("place").alias("rank"))


def top_items(joined: DataFrame, owner: str, basket: str, item: str, title: str, k: int = 5) -> DataFrame:
    """(owner, top_items): the titles of an owner's k items in most baskets (ties by item)."""
    counts = joined.groupBy(owner, item, title).agg(F.countDistinct(basket).alias("n"))
    rank = F.row_number().over(W.partitionBy(owner).orderBy(F.desc("n"), item))
    best = counts.withColumn("r", rank).where(F.col("r") <= k)
    return best.groupBy(F.col(owner).alias("owner")).agg(ordered_list([F.col("r")], title).alias("top_items"))


def top_neighbours(edges: DataFrame, counts: DataFrame, k: int = 8) -> DataFrame:
    """(owner, neighbours): the k strongest neighbours with overlap_pct, the shared baskets' share of the owner's own."""
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    best = edges.withColumn("r", rank).where(F.col("r") <= k).join(counts, F.col("src") == F.col("owner"))
    best = best.withColumn("s", F.struct(F.col("dst").alias("neighbour"), share(F.col("weight"), F.col("basket_count"), 1).alias("overlap_pct")))
    return best.groupBy("owner").agg(ordered_list([F.col("r")], "s").alias("neighbours"))


def item_stats(rows: DataFrame, names: DataFrame, item: str, basket: str, k: int = 10) -> DataFrame:
    """(item, basket_count, top_names): distinct named baskets, and the first k of their names in order, repeats included."""
    n = tasks(rows)
    named = rows.repartition(n, basket).join(names.where(F.length(F.trim("name")) > 0).repartition(n, basket), basket)
    # The first k names are picked in each task before the shuffle, so a very common item gathers nowhere.
    first = named.select(item, "name", F.row_number().over(W.partitionBy(item).orderBy("name")).alias("r")).where(F.col("r") <= k)
    return named.groupBy(item).agg(F.countDistinct(basket).alias("basket_count")).join(first.groupBy(item).agg(ordered_list([F.col("r")], "name").alias("top_names")), item)


def two_level_flags(rows: DataFrame, owner: str, basket: str, flags: list[str]) -> DataFrame:
    """Per owner: baskets, and for each flag the baskets that have it and their share; a basket counts once however many rows it has."""
    per_basket = rows.groupBy(owner, basket).agg(*(F.max(F.col(f).cast("int")).alias(f) for f in flags))
    out = per_basket.groupBy(owner).agg(F.count(F.lit(1)).alias("basket_count"), *(F.sum(f).alias(f) for f in flags))
    whole = F.greatest("basket_count", F.lit(1))
    return out.select(F.col(owner).alias("owner"), "basket_count", *flags, *(share(F.col(f), whole, 2).alias(f"{f}_pct") for f in flags))


def conditional_ratio(rows: DataFrame, keys: list[str], yes: str, no: str, k: int) -> DataFrame:
    """The k groups with most rows where no holds, of those with both kinds, and the ratio of no to yes."""
    counts = rows.groupBy(*keys).agg(F.sum(F.col(yes).cast("long")).alias("yes_count"), F.sum(F.col(no).cast("long")).alias("no_count"))
    both = counts.where("yes_count > 0 AND no_count > 0")
    return both.orderBy(F.desc("no_count"), F.desc("yes_count"), *keys).limit(k).select(
        *keys, "yes_count", "no_count", F.round(F.col("no_count") / F.greatest("yes_count", F.lit(1)), 3).alias("score")
    )


def repeat_ratio(rows: DataFrame, item: str, user: str) -> DataFrame:
    """Per item: plays, users, and the share of users with more than one play."""
    per_user = rows.groupBy(item, user).agg(F.count(F.lit(1)).alias("n"))
    return per_user.groupBy(item).agg(
        F.sum("n").alias("plays"),
        F.count(F.lit(1)).alias("users"),
        F.round(F.sum((F.col("n") > 1).cast("int")) * 1.0 / F.count(F.lit(1)), 4).alias("repeat_ratio"),
    )


def signal_rank(signals: dict[str, DataFrame], name: str) -> DataFrame:
    """Sources outer-joined on name; each signal's percent rank among positive values, their mean, and the rank by it.

    A null or zero signal is outside its own population and outside the mean.
    """
    out = None
    for s, df in signals.items():
        one = df.select(F.col(name), F.col(s))
        out = one if out is None else out.join(one, name, "full")
    for s in signals:
        place = value_ranks(out.where(F.col(s) > 0), s)
        share_below = F.when(F.col("all") > 1, F.col("before") / (F.col("all") - 1)).otherwise(F.lit(0.0))
        out = out.join(place.select(F.col(s).alias("at"), share_below.alias(f"{s}_pr")), F.col(s) == F.col("at"), "left").drop("at")
    count = sum((F.col(f"{s}_pr").isNotNull().cast("int") for s in signals), F.lit(0))
    mean = sum((F.coalesce(F.col(f"{s}_pr"), F.lit(0.0)) for s in signals), F.lit(0.0)) / F.nullif(F.col("signal_count"), F.lit(0))
    out = out.withColumn("signal_count", count).withColumn("current_pct", F.round(mean * 100, 3))
    ranked = placed(out.select(name, *signals, "signal_count", "current_pct"), [F.desc_nulls_last("current_pct"), F.col(name)])
    return ranked.withColumnRenamed("place", "current_rank")


def rank_percentile(ranked: DataFrame) -> DataFrame:
    """basicness = (1 - (rank - 1) / N) * 100, with a verdict."""
    n = ranked.select(F.count(F.lit(1)).alias("n"))
    p = rounded((1 - (F.col("rank") - 1) * 1.0 / F.col("n")) * 100, 1)
    return ranked.crossJoin(F.broadcast(n)).select("owner", "rank", p.alias("basicness")).withColumn("status", ladder(F.col("basicness"), STANDINGS))


def main_character(ranked: DataFrame, neighbours: DataFrame, listeners: DataFrame, k: int = 5) -> DataFrame:
    """rank_percentile with each owner's first k neighbours (owner, neighbours) and its listeners (owner, listeners); null where unknown."""
    near = neighbours.select("owner", F.slice("neighbours", 1, k).alias("neighbours"))
    return rank_percentile(ranked).join(near, "owner", "left").join(listeners, "owner", "left")


def cdf_scores(terms: DataFrame) -> DataFrame:
    """Each term's score: the share of terms that are as common or rarer, in percent."""
    place = value_ranks(terms, "n").select("n", F.round((F.col("before") + F.col("same")) / F.col("all") * 100, 1).alias("score"))
    return terms.select("term", "n").join(place, "n").select("term", "n", "score")


def value_ranks(rows: DataFrame, value: str) -> DataFrame:
    """(value, same, before, all): how many rows have each value, a smaller one, and any.

    Rows are counted by value before a window runs over the values alone: of counts there are few different ones however many rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("same"))
    upto = F.sum("same").over(W.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    every = F.sum("same").over(W.orderBy(value).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return counts.select(value, "same", (upto - F.col("same")).alias("before"), every.alias("all"))


def middle_half(terms: DataFrame, least: int = 10) -> DataFrame:
    """The terms whose count lies between the quartiles (linear interpolation); all of them where those are fewer than least."""
    q = terms.select(F.percentile("n", F.lit(0.25)).alias("p25"), F.percentile("n", F.lit(0.75)).alias("p75"))
    marked = terms.crossJoin(F.broadcast(q)).withColumn("mid", F.col("n").between(F.col("p25"), F.col("p75")))
    inside = marked.select(F.count_if("mid").alias("inside"))
    return marked.crossJoin(F.broadcast(inside)).where((F.col("inside") < least) | F.col("mid")).select("term", "n", "p25", "p75")


def region_rollup(points: DataFrame, label: str, value: str) -> DataFrame:
    """Per label: its slug, rows, sum, mean, and the name of the first row by id."""
    return points.groupBy(label, F.lower(F.replace(F.col(label), F.lit(" "), F.lit("_"))).alias("slug")).agg(
        F.count(F.lit(1)).alias("clusters"),
        F.sum(value).alias("total"),
        F.round(F.avg(value), 4).alias("mean"),
        F.min_by("name", "id").alias("first_name"),
    )


def most_common(rows: DataFrame, value: str, k: int = 10) -> DataFrame:
    """The k values that come most often (ties by value), how often, and their share of all rows."""
    total = rows.select(F.count(F.lit(1)).alias("total"))
    best = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(k)
    return best.crossJoin(F.broadcast(total)).select(value, "n", share(F.col("n"), F.col("total"), 1).alias("pct"))


def basket_owners(rows: DataFrame, basket: str, owner: str, k: int = 10) -> DataFrame:
    """(basket, owner, n, pct): the k owners with most rows in each basket (ties by owner) and their share of all of its rows."""
    counts = rows.groupBy(basket, owner).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(basket).agg(F.sum("n").alias("all"))
    r = F.row_number().over(W.partitionBy(basket).orderBy(F.desc("n"), owner))
    named = counts.where(F.col(owner).isNotNull()).withColumn("r", r).where(F.col("r") <= k)
    return named.join(sizes, basket).select(basket, owner, "n", share(F.col("n"), F.col("all"), 1).alias("pct"))


def first_rows(rows: DataFrame, basket: str, order: list[str], k: int = 20) -> DataFrame:
    """The first k rows of each basket, picked in each task before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(basket).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def exact_titles(titles: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """(id, title_key, exact_count, examples): how many titles equal each asked one (id, title) in normal form, and the first k
    different ones of them. A title without letters or digits equals none. titles: (name)."""
    key = text.title_key
    named = titles.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("title_key", key(F.col("name")))
    wanted = asked.select("id", key(F.col("title")).alias("title_key"))
    # Titles are counted by name first; of a key's names the window keeps k in each task.
    r = F.row_number().over(W.partitionBy("title_key").orderBy("name"))
    known = named.where("title_key <> ''").join(wanted.select("title_key").distinct(), "title_key", "left_semi")
    counts = known.groupBy("title_key").agg(F.sum("n").alias("n"))
    some = known.withColumn("r", r).where(F.col("r") <= k).groupBy("title_key").agg(ordered_list([F.col("r")], "name").alias("examples"))
    out = wanted.join(counts, "title_key", "left").join(some, "title_key", "left")
    return out.select("id", "title_key", F.coalesce("n", F.lit(0)).alias("exact_count"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def ranked_or_last(rows: DataFrame, ranks: DataFrame, key: str, rank: str) -> DataFrame:
    """rows with their rank, UNRANKED where ranks has none; of a key's ranks the least counts."""
    best = ranks.groupBy(key).agg(F.min(rank).alias("_rank"))
    return rows.join(best, key, "left").withColumn(rank, F.coalesce("_rank", F.lit(UNRANKED))).drop("_rank")


def unpivot_flags(flags: DataFrame, names: list[str]) -> DataFrame:
    """(owner, context, count, pct): two_level_flags with a row for each flag."""
    each = F.array(*(F.struct(F.lit(c).alias("context"), F.col(c).alias("count"), F.col(f"{c}_pct").alias("pct")) for c in names))
    return flags.select("owner", F.explode(each).alias("s")).select("owner", "s.context", "s.count", "s.pct")


def frequent_without(rows: DataFrame, key: str, known: DataFrame, least: int) -> DataFrame:
    """(key, n): keys in at least least rows that known lacks."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.join(known.select(key), key, "left_anti")


def large_groups(rows: DataFrame, group: str, least: int) -> DataFrame:
    """The rows of groups that have at least least of them."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return rows.join(sizes.select(group), group, "left_semi")


def title_score(titles: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, words, known, genericness): the mean score of a title's words, 0 for those that are no terms, with a verdict.

    titles: (id, words array); terms: (term, n). A title without words has no row.
    """
    scores = cdf_scores(terms).select("term", "score")
    words = titles.select("id", F.size("words").alias("words"), F.explode("words").alias("term"))
    joined = words.join(scores, "term", "left").groupBy("id", "words").agg(F.count("score").alias("known"), F.round(F.sum(F.coalesce("score", F.lit(0.0))) / F.max("words"), 1).alias("genericness"))
    g = F.col("genericness")
    verdict = F.when(g >= 90, "indistinguishable").when(g >= 70, "common").when(g >= 50, "generic").when(g >= 30, "some originality").otherwise("rare")
    return joined.withColumn("verdict", verdict)
