"""Source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import archive as a
from ..sources import readers, writers
from ..streaming import history
from . import tables as t
from .tables import PLAYS


def _positional(s, d):
    return writers.positional_json(t.table(s, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


def _list_pages(s, d):
    """Parts as list pages of ten, a title in h3 and an artist in h4 behind a mark."""
    p = t.table(s, d, "part").select(F.floor(F.col("p_partkey") / 10).alias("page_id"), "p_partkey", F.format_string('<li><h3 class="t">%s</h3><div><h4><span>E</span>%s &amp; <a>co</a></h4></div></li>', "p_name", "p_brand").alias("x"))
    pages = p.groupBy("page_id").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "x"))), lambda e: e["x"])).alias("html"))
    return readers.track_list(pages).withColumn("pos", F.col("pos").cast("bigint"))


QUERIES = {
    "genre_colors": lambda s, d: t.table(s, d, "documents").select("doc_id", text.genre_color(F.col("text")).alias("color")),
    "list_pages": _list_pages,
    "era_of_years": lambda s, d: t.table(s, d, "part").select("p_partkey", F.coalesce(*(F.when((F.col("p_size") + 1955).between(*a.era(n)), n) for n in a.ERAS if n.startswith("19"))).alias("era")),
    "html_links_extract": lambda s, d: readers.links(t.table(s, d, "pages")),
    "positional_json": _positional,
    "sessions_window": lambda s, d: history.sessions(t.listens(s, d)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "plays", "ms"),
    "weekly_counts": lambda s, d: history.weekly_counts(t.listens(s, d)),
    "weekly_calendar": lambda s, d: t.table(s, d, "orders").select(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")).select(
        F.explode(F.expr("sequence(next_day(date_sub(a, 1), 'THU'), b, interval 7 days)")).alias("thursday")
    ),
}

_COLORS = " ".join(f"WHEN contains(lower(text), '{k}') THEN '{c}'" for k, c in text.GENRE_COLORS.items())
ORACLE = {
    "genre_colors": f"SELECT doc_id, CASE {_COLORS} ELSE '{text.DEFAULT_COLOR}' END AS color FROM documents",
    "list_pages": """SELECT p_partkey // 10 AS page_id, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1 AS pos, p_name AS title, p_brand || ' & co' AS artist FROM part""",
    "era_of_years": """SELECT p_partkey, CASE WHEN p_size + 1955 BETWEEN 1960 AND 1999 THEN CAST((p_size + 1955) // 10 * 10 AS INT) || 's' END AS era FROM part""",
    "html_links_extract": """WITH m AS (SELECT page_id, regexp_extract_all(html, '<li>\\s*<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<li>\\s*<a href="([^"]*)">([^<]*)</a>', 2) AS l FROM pages WHERE html IS NOT NULL),
        r AS (SELECT page_id, unnest(range(len(h))) AS pos, h, l FROM m)
        SELECT page_id, pos, h[pos + 1] AS href, replace(replace(replace(replace(replace(l[pos + 1], '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS label FROM r""",
    "positional_json": """SELECT '{"fields":["n_nationkey","n_name"],"rows":[' || string_agg('["' || n_nationkey || '","' || n_name || '"]', ',' ORDER BY n_nationkey) || '],"n":' || count(*) || '}' AS json FROM nation""",
    "sessions_window": f"""WITH {PLAYS}, g AS (SELECT *, coalesce(CAST(ts > lag(ts) OVER w + INTERVAL 30 MINUTE AS INT), 1) AS new FROM plays WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS plays, CAST(sum(ms) AS BIGINT) AS ms FROM s GROUP BY user_id, session""",
    "weekly_counts": f"WITH {PLAYS} SELECT CAST(date_trunc('week', ts) AS DATE) AS week, track, count(*) AS plays, CAST(sum(ms) AS BIGINT) AS ms FROM plays GROUP BY ALL",
    "weekly_calendar": """WITH d AS (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS thursday FROM orders) SELECT thursday FROM d WHERE isodow(thursday) = 4""",
}
