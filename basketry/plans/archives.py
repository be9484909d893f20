"""Archive, era, chart and title queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import archive as a
from ..operators import stats
from ..session import checkpoint_dir, delete, tasks
from ..sources import writers
from ..streaming import charts
from . import tables as t
from .reach import TERMS
from .tables import BASKETS, ROWS

#: Words of the test tables' titles, in place of moods.
CATEGORIES = {"home": ["household", "furniture"], "motion": ["automobile", "machinery"], "pressing": ["urgent", "high", "1"], "calm": ["low", "not specified"]}
TAGS = {"cold": ["cold", "blue", "small"], "warm": ["hot", "red", "large"], "steel": ["bolt", "gear", "rod", "anvil", "plate"]}


def _removed(s, d):
    lines, orders = t.table(s, d, "lineitem"), t.table(s, d, "orders")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("playlist"), F.to_date("o_orderdate").alias("added"), F.when(F.col("l_returnflag") != "N", F.to_date("l_shipdate")).alias("removed"), "l_orderkey", "l_quantity", "l_extendedprice"
    )
    names = t.table(s, d, "supplier").select(F.col("s_suppkey").alias("playlist"), F.col("s_name").alias("playlist_name"))
    return a.music_only(a.lifetimes(rows, names, "playlist"), None, "playlist_name")


def _forgotten(s, d):
    removed = _removed(s, d).groupBy("id").agg(F.max("days_on").alias("days_on"), F.max("date_removed").alias("date_removed"))
    charts = _history(s, d).select(F.col("track").cast("bigint").alias("id"), "chart_peak")
    return a.forgotten(removed, charts, "id", "2001-06-01", 500, 40)


def _weeks(s, d):
    """Weekly charts: a track's plays' value in cents are its streams, its rank that among the week's tracks."""
    plays = t.listens(s, d)
    weeks = plays.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), "track").agg(F.sum("ms").alias("streams"))
    return weeks.selectExpr("week", "track", "streams", "concat('Track ', track % 40) AS name", "cast(row_number() OVER (PARTITION BY week ORDER BY streams DESC, track) AS bigint) AS rank")


def _history(s, d):
    return a.chart_history(_weeks(s, d))


def _kept_history(s, d):
    """The charts written as a CSV file for each week, those of the first half of the weeks merged before the others are there."""
    at = f"{checkpoint_dir(s)}/round-trip-{s.sparkContext.applicationId}/charts"
    delete(s, at)
    weeks = _weeks(s, d).select("rank", "track", "streams", "name", "week")
    half = weeks.agg(F.expr("percentile_approx(week, 0.5)")).first()[0]
    for some in (F.col("week") <= F.lit(half), F.col("week") > F.lit(half)):
        writers.dated_csv(weeks.where(some), "week", f"{at}/files")
        charts.keep_charts(s, f"{at}/files", "rank bigint, track int, streams bigint, name string", f"{at}/table", ["track"], f"{at}/progress", 1)
    return a.chart_history(charts.charts(s, f"{at}/table").withColumnRenamed("date", "week"))


def _era(s, d):
    orders, lines = t.table(s, d, "orders").select("o_orderkey", "o_orderdate"), t.table(s, d, "lineitem").select("l_orderkey", "l_partkey")
    n = tasks(lines)
    joined = lines.repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    years = joined.groupBy(F.col("l_partkey").alias("id")).agg(F.min(F.year("o_orderdate")).alias("year"), F.countDistinct("l_orderkey").alias("basket_count"))
    spine = t.items(s, d).select(F.col("item").alias("id"), "title", "owner").join(years.select("id", "basket_count"), "id")
    first = years.where("id % 3 <> 0")
    second = t.table(s, d, "part").where("p_partkey % 4 <> 1").select(F.col("p_partkey").alias("id"), (F.lit(1990) + F.col("p_size")).alias("year"))
    return a.era_tracks(spine, first, second, 2010)


ERA_SQL = """y AS (SELECT l_partkey AS id, CAST(min(year(o_orderdate)) AS INT) AS year, count(DISTINCT l_orderkey) AS basket_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    e0 AS (SELECT p_partkey AS id, p_name AS title, p_brand AS owner, basket_count, CASE WHEN y.id % 3 <> 0 THEN y.year END AS y1, CASE WHEN p_partkey % 4 <> 1 THEN 1990 + p_size END AS y2
           FROM part JOIN y ON y.id = p_partkey),
    e AS (SELECT id, title, owner, basket_count, coalesce(y1, y2) AS release_year, CASE WHEN y1 IS NOT NULL THEN 'first' WHEN y2 IS NOT NULL THEN 'second' END AS year_source FROM e0 WHERE coalesce(y1, y2) <= 2010)"""


def _era_top(s, d):
    return a.in_era(_era(s, d), 1995, 1999).orderBy(F.desc("basket_count"), "id").limit(20)


def _era_artists(s, d):
    per = a.in_era(_era(s, d), 1990, 1999).groupBy("owner").agg(F.sum("basket_count").alias("basket_count"), F.count(F.lit(1)).alias("tracks"), F.countDistinct("title").alias("titles"))
    return per.orderBy(F.desc("basket_count"), "owner").limit(10)


def _era_years(s, d):
    return a.in_era(_era(s, d), 1990, 2010).groupBy("release_year", text.decade(F.col("release_year")).alias("decade"), "year_source").agg(F.count(F.lit(1)).alias("tracks"))


def _contradiction(s, d):
    name = F.col("name")
    flags = t.baskets(s, d).select("pid", name.rlike(text.bounded(["low", "medium"])).alias("yes"), name.rlike(text.bounded(["urgent", "high"])).alias("no")).where("yes OR no")
    return stats.conditional_ratio(t.rows(s, d).join(flags, "pid"), ["title", "owner"], "yes", "no", 12)


def _terms(s, d):
    return text.title_terms(t.part_titles(s, d), 20, 60)


def _habitat_blend(s, d):
    parts = t.table(s, d, "part")
    tags = parts.groupBy(F.col("p_brand").alias("owner")).agg(F.array_distinct(F.flatten(F.collect_list(F.split("p_name", " ")))).alias("tags"))
    own = parts.where("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("owner")).agg(F.round(F.avg("p_size"), 1).alias("pct")).select("owner", F.lit("steel").alias("context"), "pct")
    return a.blend_scores(own, a.habitat_scores(tags, TAGS))


def _cleaned(s, d):
    title = F.concat(F.initcap("p_name"), F.element_at(F.array(*map(F.lit, [" (feat. Someone)", " - Remastered 2009", " (Live Remaster)", " - Radio Edit", "", " ft. A & B"])), (F.col("p_partkey") % 6 + 1).cast("int")))
    rows = t.table(s, d, "part").select("p_partkey", title.alias("title"), "p_name")
    cleaned = text.clean_title(F.col("title"))
    return rows.select("p_partkey", cleaned.alias("cleaned"), text.similar(F.col("title"), F.col("p_name")).alias("similar"), text.genre_color(F.col("p_name")).alias("color"))


def _chart_years(s, d):
    year = F.when(F.col("p_partkey") % 3 == 0, "unknown").otherwise((F.col("p_size") + 1950).cast("string"))
    spine = t.table(s, d, "part").select(F.col("p_partkey").cast("int").alias("track"), year.alias("release_year"))
    return a.chart_years(_weeks(s, d).where("rank <= 10").select("week", "track", "rank"), spine)


QUERIES = {
    "chart_release_years": _chart_years,
    "editorial_removed": _removed,
    "forgotten_hits": _forgotten,
    "chart_history": _history,
    "chart_history_kept": _kept_history,
    "chart_number_ones": lambda s, d: a.number_ones(_history(s, d), 2024, 2024),
    "era_capsule_top": _era_top,
    "era_artists": _era_artists,
    "era_years": _era_years,
    "mood_contradiction": _contradiction,
    "mood_map_clusters": lambda s, d: a.mood_map(t.baskets(s, d), CATEGORIES),
    "title_terms_df": _terms,
    "term_related": lambda s, d: a.related_terms(_terms(s, d), "red-widget"),
    "habitat_tag_blend": _habitat_blend,
    "title_cleaning": _cleaned,
}


def _bounded(words):
    return "(^|[^A-Za-z0-9_])(" + "|".join(words) + ")([^A-Za-z0-9_]|$)"


_REMOVED = """lt AS (SELECT l_partkey AS id, l_suppkey AS playlist, CAST(o_orderdate AS DATE) AS added, CAST(l_shipdate AS DATE) AS removed, l_orderkey, l_quantity, l_extendedprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N'),
    removed AS (SELECT playlist, id, l_orderkey, l_quantity, l_extendedprice, s_name AS playlist_name, CAST(greatest(date_diff('day', added, removed), 0) AS INT) AS days_on,
        strftime(added, '%Y-%m-%d') AS date_added, strftime(removed, '%Y-%m-%d') AS date_removed FROM lt LEFT JOIN supplier ON s_suppkey = playlist)"""
_WEEKS = f"""{t.PLAYS}, ws AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, track, CAST(sum(ms) AS BIGINT) AS streams FROM plays GROUP BY ALL),
    weeks AS (SELECT *, 'Track ' || (track % 40) AS name, row_number() OVER (PARTITION BY week ORDER BY streams DESC, track) AS rank FROM ws),
    history AS (SELECT track, arg_min(name, week) AS name, min(rank) AS chart_peak, count(*) AS total_weeks, max(streams) AS max_streams_week, CAST(sum(streams) AS BIGINT) AS total_streams,
        min(week) AS first_charted, max(week) AS last_charted, arg_min(week, rank * 100000 + date_diff('day', DATE '2000-01-01', week)) AS peak_date FROM weeks GROUP BY 1)"""
_CATS = " UNION ALL ".join(f"SELECT '{c}' AS category, name FROM baskets WHERE regexp_matches(name, '{_bounded(w)}')" for c, w in CATEGORIES.items())
_TAGS_SQL = " UNION ALL ".join(f"SELECT owner, '{c}' AS context, round(least(len(list_intersect(tags, {w!r})) / {max(0.15 * len(w), 1)}, 1.0) * 40.0, 2) AS score FROM tags" for c, w in TAGS.items())
_TERM_ROWS = """tt AS (SELECT p_partkey AS id, p_name AS name, [x for x in string_split(p_name, ' ') if length(x) >= 2 AND x NOT IN ('hot', 'new', 'top')] AS w FROM part),
    gr AS (SELECT DISTINCT id, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS term FROM tt),
    tc AS (SELECT term, count(*) AS count FROM gr GROUP BY 1 HAVING count(*) >= 20 ORDER BY count DESC, term LIMIT 60),
    ex AS (SELECT term, name FROM tc JOIN (SELECT DISTINCT name, w FROM tt) ON list_has_all(w, string_split(term, ' '))),
    trows AS (SELECT term, count, round(count * 100.0 / (SELECT count(*) FROM part), 3) AS pct, 'other' AS theme, (SELECT list(name ORDER BY name)[1:5] FROM ex WHERE ex.term = tc.term) AS examples FROM tc)"""

ORACLE = {
    "editorial_removed": f"WITH {_REMOVED} SELECT * FROM removed",
    "forgotten_hits": f"""WITH {_REMOVED}, {_WEEKS}, r AS (SELECT id, max(days_on) AS days_on, max(date_removed) AS date_removed FROM removed GROUP BY 1),
        b AS (SELECT * FROM r WHERE days_on >= 500 AND CAST(date_removed AS DATE) < DATE '2001-06-01' - 365 ORDER BY days_on DESC, date_removed DESC, id LIMIT 40)
        SELECT b.*, chart_peak FROM b LEFT JOIN history ON track = id""",
    "chart_history": f"WITH {_WEEKS} SELECT * FROM history",
    "chart_history_kept": f"WITH {_WEEKS} SELECT * FROM history",
    "chart_release_years": f"""WITH {t.PLAYS}, ws AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, track, sum(ms) AS streams FROM plays GROUP BY ALL),
        r AS (SELECT week, track, row_number() OVER (PARTITION BY week ORDER BY streams DESC, track) AS rank FROM ws QUALIFY rank <= 10)
        SELECT week, track, rank, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size + 1950 AS INT) END AS release_year FROM r LEFT JOIN part ON p_partkey = track""",
    "chart_number_ones": f"""WITH {_WEEKS}, o AS (SELECT track, name, max_streams_week, peak_date FROM history WHERE chart_peak = 1 AND year(peak_date) = 2024
            QUALIFY row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY max_streams_week DESC, track) = 1)
        SELECT * FROM o ORDER BY max_streams_week DESC, track LIMIT 10""",
    "era_capsule_top": f"WITH {ERA_SQL} SELECT * FROM e WHERE release_year BETWEEN 1995 AND 1999 ORDER BY basket_count DESC, id LIMIT 20",
    "era_artists": f"""WITH {ERA_SQL} SELECT owner, CAST(sum(basket_count) AS BIGINT) AS basket_count, count(*) AS tracks, count(DISTINCT title) AS titles FROM e
        WHERE release_year BETWEEN 1990 AND 1999 GROUP BY 1 ORDER BY basket_count DESC, owner LIMIT 10""",
    "era_years": f"WITH {ERA_SQL} SELECT release_year, CAST(release_year // 10 * 10 AS INT) AS decade, year_source, count(*) AS tracks FROM e WHERE release_year BETWEEN 1990 AND 2010 GROUP BY ALL",
    "mood_contradiction": f"""WITH {ROWS}, {BASKETS}, f AS (SELECT pid, regexp_matches(name, '{_bounded(["low", "medium"])}') AS yes, regexp_matches(name, '{_bounded(["urgent", "high"])}') AS no FROM baskets),
        c AS (SELECT title, owner, count(*) FILTER (yes) AS yes_count, count(*) FILTER (no) AS no_count FROM rows JOIN f USING (pid) GROUP BY ALL)
        SELECT title, owner, yes_count, no_count, round(no_count / greatest(yes_count, 1), 3) AS score FROM c WHERE yes_count > 0 AND no_count > 0
        ORDER BY no_count DESC, yes_count DESC, title, owner LIMIT 12""",
    "mood_map_clusters": f"""WITH {BASKETS}, h AS ({_CATS}), m AS (SELECT count(*) AS n FROM baskets),
        w0 AS (SELECT category, regexp_replace(unnest(string_split(name, ' ')), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') AS w FROM h),
        w AS (SELECT category, w, count(*) AS n FROM w0 WHERE length(w) > 3 GROUP BY category, w QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, w) <= 8),
        tw AS (SELECT category, list(w ORDER BY n DESC, w) AS top_terms FROM w GROUP BY 1),
        am AS (SELECT count(*) AS total_matched FROM baskets WHERE {' OR '.join(f"regexp_matches(name, '{_bounded(w)}')" for w in CATEGORIES.values())})
        SELECT category, count(*) AS count, round(count(*) * 100.0 / (SELECT n FROM m), 2) AS pct, any_value(top_terms) AS top_terms, (SELECT total_matched FROM am) AS total_matched, (SELECT count(*) FROM h) AS assignments
        FROM h LEFT JOIN tw USING (category) GROUP BY 1""",
    "title_terms_df": f"WITH {_TERM_ROWS} SELECT * FROM trows",
    "term_related": f"WITH {_TERM_ROWS} SELECT 'red widget' AS of, term, theme, count FROM trows WHERE term <> 'red widget' AND theme = (SELECT theme FROM trows WHERE term = 'red widget') ORDER BY count DESC, term LIMIT 8",
    "habitat_tag_blend": f"""WITH tags AS (SELECT p_brand AS owner, list_distinct(flatten(list(string_split(p_name, ' ')))) AS tags FROM part GROUP BY 1),
        sc AS ({_TAGS_SQL}), own AS (SELECT p_brand AS owner, 'steel' AS context, round(avg(p_size), 1) AS pct FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1)
        SELECT coalesce(own.owner, sc.owner) AS owner, coalesce(own.context, sc.context) AS context,
               round(CASE WHEN pct IS NULL THEN score WHEN coalesce(score, 0) > 0 THEN CAST(0.7 AS DOUBLE) * pct + (1 - CAST(0.7 AS DOUBLE)) * score ELSE pct END, 2) AS pct
        FROM own FULL JOIN sc ON own.owner = sc.owner AND own.context = sc.context""",
    "title_cleaning": """SELECT p_partkey, array_to_string([upper(x[1]) || x[2:] for x in string_split(p_name, ' ')], ' ') AS cleaned, true AS similar, '#64748B' AS color FROM part""",
}
