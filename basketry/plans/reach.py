"""Reach, rank and top-list queries over baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, stats
from ..session import tasks
from . import tables as t
from .tables import BASKETS, ROWS

#: Keywords of the basket titles of the test tables, in place of listening contexts; matched as bare substrings.
CONTEXTS = {"home": ["house", "furn"], "work": ["mach", "build"], "rush": ["urgent", "high"], "slow": ["low", "not spec"]}


def _habitat(s, d):
    flags = [F.col("name").rlike("|".join(words)).alias(c) for c, words in CONTEXTS.items()]
    labelled = t.baskets(s, d).select("pid", *flags)
    n = tasks(t.basket_items(s, d))
    return stats.two_level_flags(t.rows(s, d).repartition(n, "pid").join(labelled.repartition(n, "pid"), "pid"), "owner", "pid", list(CONTEXTS))


def _coartists(s, d):
    edges = graph.symmetric(graph.cooccurrence(t.basket_items(s, d), "pid", "node"))
    return stats.top_neighbours(edges, t.supplier_reach(s, d), 8).select(
        "owner", F.transform("neighbours", lambda x: F.concat_ws(":", x["neighbour"], F.format_string("%.1f", x["overlap_pct"]))).alias("neighbours")
    )


def _popularity(s, d):
    item = t.table(s, d, "lineitem")
    name = lambda c, n: F.concat(F.lit("n"), (F.col(c) % n).cast("string")).alias("name")
    qty = item.where("l_suppkey % 5 <> 0").groupBy(name("l_suppkey", 40)).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    lines = item.where("l_partkey % 3 = 0").groupBy(name("l_partkey", 30)).agg(F.count(F.lit(1)).alias("lines"))
    events = t.listens(s, d).where("track >= 20").groupBy(name("track", 50)).agg(F.count(F.lit(1)).alias("events"))
    return stats.signal_rank({"quantity": qty, "lines": lines, "events": events}, "name")


def _terms(s, d):
    return text.title_terms(t.part_titles(s, d), min_count=1, top=500).select("term", F.col("count").alias("n"))


QUERIES = {
    "artist_reach_rank": lambda s, d: stats.reach_rank(t.rows(s, d), "owner", "pid"),
    "artist_top_tracks": lambda s, d: stats.top_items(t.rows(s, d), "owner", "pid", "item", "title"),
    "artist_top_coartists": _coartists,
    "track_stats_names": lambda s, d: stats.item_stats(t.basket_items(s, d), t.baskets(s, d), "item", "pid"),
    "habitat_two_level": _habitat,
    "repeat_ratio": lambda s, d: stats.repeat_ratio(t.listens(s, d), "track", "user_id"),
    "popularity_outer_pctrank": _popularity,
    "percentile_basicness": lambda s, d: stats.rank_percentile(stats.reach_rank(t.basket_items(s, d), "node", "pid")),
    "cdf_roast_score": lambda s, d: stats.cdf_scores(_terms(s, d)),
    "iqr_terms": lambda s, d: stats.middle_half(_terms(s, d)),
    "genre_regions": lambda s, d: stats.region_rollup(
        t.table(s, d, "part").select(F.col("p_type").alias("region"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("size")), "region", "size"
    ),
}

_RANKED = """r AS (SELECT {owner} AS owner, count(DISTINCT l_orderkey) AS basket_count FROM lineitem JOIN part ON l_partkey = p_partkey
                  WHERE {owner} IS NOT NULL GROUP BY 1),
    n AS (SELECT count(DISTINCT l_orderkey) AS total FROM lineitem JOIN part ON l_partkey = p_partkey),
    ranked AS (SELECT owner, basket_count, round(basket_count * 100.0 / total, 3) AS basket_pct,
                      CAST(row_number() OVER (ORDER BY basket_count DESC, owner) AS BIGINT) AS rank FROM r, n)"""
_FLAGS = ", ".join(f"CAST(regexp_matches(name, '{'|'.join(w)}') AS INT) AS {c}" for c, w in CONTEXTS.items())
TERMS = """raw AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w FROM part),
    toks AS (SELECT id, [x for x in w if length(x) >= 2 AND x NOT IN ('hot', 'new', 'top')] AS w FROM raw),
    grams AS (SELECT DISTINCT id, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS term FROM toks),
    terms AS (SELECT term, count(*) AS n FROM grams GROUP BY 1 ORDER BY n DESC, term LIMIT 500)"""

ORACLE = {
    "artist_reach_rank": f"WITH {_RANKED.format(owner='p_brand')} SELECT * FROM ranked",
    "artist_top_tracks": f"""WITH {ROWS}, c AS (SELECT owner, item, title, count(DISTINCT pid) AS n FROM rows GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, item) AS r FROM c)
        SELECT owner, list(title ORDER BY r) AS top_items FROM r WHERE r <= 5 GROUP BY owner""",
    "artist_top_coartists": f"""WITH {t.REACH}, {t.edges_sql()},
        r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM both_ways)
        SELECT src AS owner, list(dst || ':' || format('{{:.1f}}', round(weight * 100.0 / basket_count, 1)) ORDER BY r) AS neighbours
        FROM r JOIN reach ON src = owner WHERE r <= 8 GROUP BY src""",
    "track_stats_names": f"""WITH {BASKETS} SELECT l_partkey AS item, count(DISTINCT pid) AS basket_count, list(name ORDER BY name)[1:10] AS top_names
        FROM lineitem JOIN baskets ON l_orderkey = pid WHERE length(trim(name)) > 0 GROUP BY 1""",
    "habitat_two_level": f"""WITH {ROWS}, {BASKETS}, l AS (SELECT pid, {_FLAGS} FROM baskets),
        p AS (SELECT owner, pid, {', '.join(f'max({c}) AS {c}' for c in CONTEXTS)} FROM rows JOIN l USING (pid) GROUP BY ALL)
        SELECT owner, count(*) AS basket_count, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}, round(sum({c}) * 100.0 / count(*), 2) AS {c}_pct' for c in CONTEXTS)} FROM p GROUP BY owner""",
    "repeat_ratio": f"""WITH {t.PLAYS}, u AS (SELECT track, user_id, count(*) AS n FROM plays GROUP BY ALL)
        SELECT track, CAST(sum(n) AS BIGINT) AS plays, count(*) AS users, round(count(*) FILTER (n > 1) * 1.0 / count(*), 4) AS repeat_ratio FROM u GROUP BY 1""",
    "popularity_outer_pctrank": f"""WITH {t.PLAYS},
        q AS (SELECT 'n' || (l_suppkey % 40) AS name, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1),
        l AS (SELECT 'n' || (l_partkey % 30) AS name, count(*) AS lines FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1),
        e AS (SELECT 'n' || (track % 50) AS name, count(*) AS events FROM plays WHERE track >= 20 GROUP BY 1),
        j AS (SELECT name, quantity, lines, events FROM q FULL JOIN l USING (name) FULL JOIN e USING (name)),
        p AS (SELECT *, {', '.join(f"CASE WHEN {c} > 0 THEN percent_rank() OVER (PARTITION BY coalesce({c} > 0, false) ORDER BY {c}) END AS {c}_pr" for c in ('quantity', 'lines', 'events'))} FROM j),
        m AS (SELECT *, CAST((quantity_pr IS NOT NULL) AS INT) + CAST((lines_pr IS NOT NULL) AS INT) + CAST((events_pr IS NOT NULL) AS INT) AS signal_count FROM p),
        s AS (SELECT name, quantity, lines, events, signal_count,
              round((coalesce(quantity_pr, 0.0) + coalesce(lines_pr, 0.0) + coalesce(events_pr, 0.0)) / nullif(signal_count, 0) * 100, 3) AS current_pct FROM m)
        SELECT *, CAST(row_number() OVER (ORDER BY current_pct DESC NULLS LAST, name) AS BIGINT) AS current_rank FROM s""",
    "percentile_basicness": f"""WITH {_RANKED.format(owner='l_suppkey')},
        b AS (SELECT owner, rank, round((1 - (rank - 1) * 1.0 / (SELECT count(*) FROM ranked)) * 100, 1) AS basicness FROM ranked)
        SELECT *, CASE WHEN basicness >= 90 THEN 'top_decile' WHEN basicness >= 75 THEN 'high_reach' WHEN basicness >= 50 THEN 'above_median_reach' ELSE 'focused_reach' END AS status FROM b""",
    "cdf_roast_score": f"WITH {TERMS} SELECT term, n, round(cume_dist() OVER (ORDER BY n) * 100, 1) AS score FROM terms",
    "iqr_terms": f"""WITH {TERMS}, q AS (SELECT quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.75) AS p75 FROM terms),
        m AS (SELECT term, n, p25, p75, n BETWEEN p25 AND p75 AS mid FROM terms, q)
        SELECT term, n, p25, p75 FROM m WHERE mid OR (SELECT count(*) FILTER (mid) FROM m) < 10""",
    "genre_regions": """SELECT p_type AS region, lower(replace(p_type, ' ', '_')) AS slug, count(*) AS clusters, CAST(sum(p_size) AS BIGINT) AS total, round(avg(p_size), 4) AS mean, arg_min(p_name, p_partkey) AS first_name
        FROM part GROUP BY 1""",
}
