"""Queries over the event history as plays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listening as l
from . import tables as t
from .tables import PLAYS


def _charted(s, d):
    weeks = t.listens(s, d).groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), "track").agg(F.sum("ms").alias("ms"))
    ranked = weeks.selectExpr("*", "row_number() OVER (PARTITION BY week ORDER BY ms DESC, track) AS r").where("r <= 20")
    return ranked.groupBy("track").agg(F.min("week").alias("first_charted"))


def _points(s, d):
    p = t.table(s, d, "part")
    return p.select(F.col("p_brand").alias("region"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def _bought(s, d):
    """Orders as plays: a customer's purchase from a supplier on a day, over seven years."""
    orders = t.table(s, d, "orders").select(F.col("o_orderkey").alias("pid"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    return orders.join(t.basket_items(s, d).select("pid", F.col("node").alias("artist")), "pid")


QUERIES = {
    "discovery_monthly_orders": lambda s, d: l.discovery(_bought(s, d), "artist", "month"),
    "listening_summary": lambda s, d: l.totals(t.listens(s, d)),
    "listening_hours": lambda s, d: l.hours(t.listens(s, d)),
    "listening_top": lambda s, d: l.top(t.listens(s, d), "track"),
    "sessions_gap30": lambda s, d: l.sessions(t.listens(s, d)),
    "artist_clock_circular": lambda s, d: l.artist_clock(t.listens(s, d)),
    "obsession_14d": lambda s, d: l.obsessions(t.listens(s, d)),
    "concentration_lorenz": lambda s, d: l.concentration(t.listens(s, d)),
    "discovery_weekly": lambda s, d: l.discovery(t.listens(s, d)),
    "taste_drift": lambda s, d: l.drift(t.listens(s, d)),
    "discovery_monthly": lambda s, d: l.discovery(t.listens(s, d), "artist", "month"),
    "taste_drift_monthly": lambda s, d: l.drift(t.listens(s, d), 8, "month"),
    "calendar_daily": lambda s, d: l.calendar(t.listens(s, d)),
    "chart_timing_lead": lambda s, d: l.chart_lead(t.listens(s, d), _charted(s, d), 20),
    "corpus_reference": lambda s, d: l.corpus_reference(t.listens(s, d), t.supplier_reach(s, d).where("owner <> 3")),
    "genre_neighbors": lambda s, d: l.neighbouring_regions(_points(s, d)),
}

_PI = "3.141592653589793"
ORACLE = {
    "listening_summary": f"""WITH {PLAYS} SELECT user_id, CAST(sum(ms) AS BIGINT) AS ms, count(*) FILTER (ms >= 30000) AS plays, count(DISTINCT artist) FILTER (ms >= 30000) AS artists,
        count(DISTINCT CAST(ts AS DATE)) AS active_days FROM plays GROUP BY 1""",
    "listening_hours": f"""WITH {PLAYS}, h AS (SELECT isodow(ts) >= 6 AS weekend, CAST(hour(ts) AS INT) AS hour, CAST(sum(ms) AS BIGINT) AS ms, count(*) AS plays FROM plays GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY weekend ORDER BY ms DESC, hour) = 1 AS peak FROM h""",
    "listening_top": f"""WITH {PLAYS}, p AS (SELECT track, CAST(sum(ms) AS BIGINT) AS ms, count(*) AS plays, round(avg(CAST(type = 'error' AS INT)), 4) AS skip_rate FROM plays GROUP BY 1 ORDER BY ms DESC, track LIMIT 10),
        d AS (SELECT track, CAST(ts AS DATE) AS day, sum(ms) AS day_ms FROM plays GROUP BY ALL),
        b AS (SELECT track, day AS busiest_day FROM d QUALIFY row_number() OVER (PARTITION BY track ORDER BY day_ms DESC, day) = 1)
        SELECT p.*, busiest_day FROM p JOIN b USING (track)""",
    "sessions_gap30": f"""WITH {PLAYS}, g AS (SELECT *, coalesce(CAST(ts > lag(ts) OVER w + INTERVAL 30 MINUTE AS INT), 1) AS new FROM plays WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g)
        SELECT user_id, session, min(ts) AS start, CAST(hour(min(ts)) AS INT) AS start_hour, count(*) AS plays, CAST(sum(ms) AS BIGINT) AS ms,
               CAST(date_sub('microsecond', min(ts), max(ts)) // 60000000 AS BIGINT) AS minutes FROM s GROUP BY 1, 2""",
    "artist_clock_circular": f"""WITH {PLAYS}, p AS (SELECT artist, count(*) AS plays, avg(sin(hour(ts) * 2 * {_PI} / 24)) AS s, avg(cos(hour(ts) * 2 * {_PI} / 24)) AS c FROM plays GROUP BY 1 ORDER BY plays DESC, artist LIMIT 12),
        r AS (SELECT *, round(atan2(s, c) * 24 / (2 * {_PI}), 3) AS h FROM p)
        SELECT artist, plays, CASE WHEN h < 0 THEN h + 24 ELSE h END AS mean_hour, round(sqrt(s * s + c * c), 4) AS focus FROM r""",
    "obsession_14d": f"""WITH {PLAYS}, e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM plays),
        c AS (SELECT *, count(*) OVER (PARTITION BY user_id, track ORDER BY sec RANGE BETWEEN CURRENT ROW AND 1209600 FOLLOWING) AS peak_plays, max(sec) OVER (PARTITION BY user_id, track) AS last_at FROM e)
        SELECT user_id, track, peak_plays, CAST(ts AS DATE) AS window_start, last_at <= sec + 1209600 AS abandoned FROM c
        QUALIFY row_number() OVER (PARTITION BY user_id, track ORDER BY peak_plays DESC, sec, event_id) = 1 AND peak_plays >= 2""",
    "concentration_lorenz": f"""WITH {PLAYS}, p AS (SELECT artist, CAST(sum(ms) AS BIGINT) AS ms FROM plays GROUP BY 1),
        c AS (SELECT artist, row_number() OVER w AS rank, sum(ms) OVER (ORDER BY ms DESC, artist ROWS UNBOUNDED PRECEDING) AS running, sum(ms) OVER () AS all_ms, count(*) OVER () AS n FROM p WINDOW w AS (ORDER BY ms DESC, artist))
        SELECT artist, rank, round(rank * 100.0 / n, 2) AS x, round(CAST(running AS DOUBLE) * 100.0 / CAST(all_ms AS DOUBLE), 2) AS y,
               min(rank) FILTER (running * 2 >= all_ms) OVER () AS artists_for_half, round(max(CAST(running AS DOUBLE) * 100.0 / CAST(all_ms AS DOUBLE)) FILTER (rank <= 10) OVER (), 2) AS top10_share FROM c""",
    "discovery_weekly": f"""WITH {PLAYS}, f AS (SELECT user_id, track, min(ts) AS first FROM plays GROUP BY ALL),
        w AS (SELECT user_id, CAST(date_trunc('week', first) AS DATE) AS week, count(*) AS discovered FROM f GROUP BY ALL)
        SELECT * FROM w QUALIFY week > min(week) OVER (PARTITION BY user_id)""",
    "taste_drift": f"""WITH {PLAYS}, b AS (SELECT artist FROM plays GROUP BY 1 ORDER BY sum(ms) DESC, artist LIMIT 8)
        SELECT artist, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(sum(ms) AS BIGINT) AS ms FROM plays JOIN b USING (artist) GROUP BY ALL""",
    "discovery_monthly_orders": """WITH f AS (SELECT o_custkey AS user_id, l_suppkey AS artist, min(o_orderdate) AS first FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
        w AS (SELECT user_id, CAST(date_trunc('month', first) AS DATE) AS month, count(*) AS discovered FROM f GROUP BY ALL)
        SELECT * FROM w QUALIFY month > min(month) OVER (PARTITION BY user_id)""",
    "discovery_monthly": f"""WITH {PLAYS}, f AS (SELECT user_id, artist, min(ts) AS first FROM plays GROUP BY ALL),
        w AS (SELECT user_id, CAST(date_trunc('month', first) AS DATE) AS month, count(*) AS discovered FROM f GROUP BY ALL)
        SELECT * FROM w QUALIFY month > min(month) OVER (PARTITION BY user_id)""",
    "taste_drift_monthly": f"""WITH {PLAYS}, b AS (SELECT artist FROM plays GROUP BY 1 ORDER BY sum(ms) DESC, artist LIMIT 8)
        SELECT artist, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(sum(ms) AS BIGINT) AS ms FROM plays JOIN b USING (artist) GROUP BY ALL""",
    "calendar_daily": f"""WITH {PLAYS}, d AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(ms) AS BIGINT) AS ms FROM plays GROUP BY 1),
        c AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
        SELECT day, coalesce(ms, 0) AS ms FROM c LEFT JOIN d USING (day)""",
    "chart_timing_lead": f"""WITH {PLAYS}, w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, track, sum(ms) AS ms FROM plays GROUP BY ALL),
        r AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY week ORDER BY ms DESC, track) <= 20),
        c AS (SELECT track, min(week) AS first_charted FROM r GROUP BY 1),
        f AS (SELECT user_id, track, min(CAST(ts AS DATE)) AS first_play FROM plays GROUP BY ALL), b AS (SELECT user_id, min(CAST(ts AS DATE)) AS began FROM plays GROUP BY 1),
        k AS (SELECT user_id, track, CAST(date_diff('day', first_play, first_charted) AS INT) AS lead_days FROM f JOIN c USING (track) JOIN b USING (user_id) WHERE first_charted >= began AND abs(date_diff('day', first_play, first_charted)) <= 20)
        SELECT user_id, track, lead_days, lead_days > 0 AS early, CAST(quantile_cont(lead_days, 0.5) OVER (PARTITION BY user_id) AS DOUBLE) AS median_lead FROM k""",
    "corpus_reference": f"""WITH {PLAYS}, {t.REACH}, b AS (SELECT artist, CAST(sum(ms) AS BIGINT) AS ms FROM plays GROUP BY 1 ORDER BY ms DESC, artist LIMIT 8)
        SELECT artist, ms, basket_count, owner IS NULL AS absent FROM b LEFT JOIN (SELECT * FROM reach WHERE owner <> 3) ON owner = artist""",
    "genre_neighbors": """WITH c AS (SELECT p_brand AS region, avg(CAST(p_size AS DOUBLE)) AS x, avg(p_retailprice) AS y FROM part GROUP BY 1 ORDER BY count(*) DESC, region LIMIT 14),
        p AS (SELECT a.region, b.region AS near, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 4) AS distance FROM c a JOIN c b ON a.region <> b.region)
        SELECT *, row_number() OVER (PARTITION BY region ORDER BY distance, near) AS rank FROM p""",
}
