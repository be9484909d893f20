"""Enrichment merges and the profile queries built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import archive, stats, vectors
from ..operators import matching as m
from . import tables as t
from .reach import TERMS
from .tables import BASKETS, ROWS


def _fill(s, d):
    parts = t.table(s, d, "part")
    base = parts.select("p_partkey", F.upper("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, None).when(F.col("p_partkey") % 3 == 1, F.array().cast("array<string>")).otherwise(F.array("p_type")).alias("tags"))
    source = parts.where("p_size > 10").select(F.col("p_name").alias("name"), F.split("p_name", " ").alias("tags"))
    return m.fill_empty_lists(base, source, "name", "tags")


def _dates(s, d):
    orders = t.table(s, d, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    base = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, iso).alias("released"))
    log = orders.where("o_orderkey % 3 = 0").select((F.col("o_orderkey") + 0.0).alias("id"), F.when(F.col("o_orderkey") % 9 == 0, "not a date").otherwise(F.lit("2001-02-03")).alias("released"))
    return m.patch_dates(base, log, "id", "released")


def _hops(s, d):
    lines = t.table(s, d, "lineitem")
    base = t.table(s, d, "orders").select(F.col("o_orderkey").alias("code"))
    first = lines.select(F.col("l_orderkey").alias("code"), F.col("l_partkey").alias("recording"))
    second = t.table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("recording"), (F.col("p_partkey") % 50).alias("target"))
    counts = lines.groupBy((F.col("l_suppkey") % 40).alias("target")).agg(F.count(F.lit(1)).alias("listen_count"))
    return m.two_hop(base, first, second, counts)


def _lookup(s, d):
    parts = t.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_size").alias("peak"))
    asked = parts.select("id", F.concat(F.lit(" "), F.upper("title")).alias("title"), "artist")
    return m.by_id_else_name(asked, parts.where("id % 7 = 0"), "peak")


def _best_source(s, d):
    p = t.table(s, d, "part")
    a = p.where("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") > 20).alias("matched"), F.col("p_brand").alias("isrc"))
    b = p.where("p_partkey % 3 = 0").select("p_partkey", (F.col("p_size") > 40).alias("matched"), F.col("p_type").alias("second_id"))
    order = [F.desc("matched"), F.desc(F.col("isrc").isNotNull()), F.desc(F.col("second_id").isNotNull())]
    return m.best_of_sources([a, b], "p_partkey", order)


def _standing(s, d):
    ranked = stats.reach_rank(t.rows(s, d), "owner", "pid")
    top = stats.top_items(t.rows(s, d), "owner", "pid", "item", "title", 3)
    current = t.table(s, d, "part").groupBy(F.col("p_brand").alias("owner")).agg(F.count(F.lit(1)).alias("current"))
    return ranked.join(top, "owner").join(current, "owner", "left").select("owner", "basket_count", "rank", F.concat_ws("; ", "top_items").alias("top_items"), "current")


def _passport(s, d):
    named = stats.item_stats(t.basket_items(s, d), t.baskets(s, d), "item", "pid", 3)
    extra = t.table(s, d, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("listens"), F.slice(F.split("p_name", " "), 1, 8).alias("genres"), F.round("p_retailprice", 4).alias("energy"))
    total = t.baskets(s, d).select(F.countDistinct("pid").alias("total"))
    shares = named.crossJoin(F.broadcast(total)).withColumn("pct", stats.share(F.col("basket_count"), F.col("total"), 3))
    return shares.join(extra, "item", "left").select("item", "basket_count", "pct", F.concat_ws("|", "top_names").alias("top_names"), "listens", F.concat_ws("|", "genres").alias("genres"), "energy")


def _profile(s, d):
    terms = text.title_terms(t.part_titles(s, d), 1, 500).select("term", F.col("count").alias("n"))
    words = t.part_titles(s, d).select("id", F.explode(text.profile_words(F.concat("name", F.lit("'s zebra")))).alias("term"))
    return words.join(terms, "term", "left").select("id", "term", F.coalesce("n", F.lit(0)).alias("n"))


def _titles(s, d):
    terms = text.title_terms(t.part_titles(s, d), 1, 500).select("term", F.col("count").alias("n"))
    asked = t.part_titles(s, d).select("id", text.roast_words(F.concat("name", F.when(F.col("id") % 2 == 0, ", zebra").otherwise(""))).alias("words"))
    return stats.title_score(asked, terms)


def _mode(s, d):
    p = t.table(s, d, "part")
    points = p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_size") % 7).alias("cluster_id"))
    return vectors.cluster_labels(points, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")))


def _context(s, d):
    flags = archive.mood_flags("high", F.col("name"))
    return t.baskets(s, d).select("pid", flags[0].alias("is_mood"), flags[1].alias("is_contrary")).groupBy("is_mood", "is_contrary").agg(F.count(F.lit(1)).alias("baskets"))


def _images(s, d):
    names = t.table(s, d, "part").select(F.initcap("p_name").alias("name"))
    images = t.table(s, d, "part").where("p_name LIKE 'r%'").select(F.col("p_name").alias("name"), F.concat(F.lit("http://img/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("image_url"))
    return m.with_images(names, images)


def _share(s, d):
    return stats.most_common(t.rows(s, d), "owner")


QUERIES = {
    "artist_images": _images,
    "fill_empty_lists": _fill,
    "coerced_key_patch": _dates,
    "two_hop_counts": _hops,
    "lookup_by_id_else_name": _lookup,
    "best_of_sources": _best_source,
    "artist_standing": _standing,
    "song_passport": _passport,
    "playlist_profile": _profile,
    "title_roast": _titles,
    "cluster_mode_labels": _mode,
    "unknown_mood": _context,
    "most_common_share": _share,
    "frequent_unmatched": lambda s, d: stats.frequent_without(t.basket_items(s, d), "item", t.items(s, d).where("owner < 'Brand#3'"), 3),
    "large_groups": lambda s, d: stats.large_groups(t.items(s, d), "title", 4).select("item", "title"),
}

ORACLE = {
    "artist_images": """WITH n AS (SELECT DISTINCT array_to_string([upper(x[1]) || x[2:] for x in string_split(p_name, ' ')], ' ') AS name FROM part ORDER BY 1 LIMIT 50)
        SELECT name, CASE WHEN name LIKE 'R%' THEN 'http://img/' || replace(lower(name), ' ', '-') END AS image_url,
               CASE WHEN name NOT LIKE 'R%' THEN upper(string_split(name, ' ')[1][1] || string_split(name, ' ')[2][1]) END AS placeholder FROM n""",
    "fill_empty_lists": """WITH b AS (SELECT p_partkey, upper(p_name) AS name, CASE WHEN p_partkey % 3 = 2 THEN [p_type] WHEN p_partkey % 3 = 1 THEN []::VARCHAR[] END AS tags FROM part),
        s AS (SELECT DISTINCT lower(p_name) AS k, string_split(p_name, ' ') AS new FROM part WHERE p_size > 10)
        SELECT p_partkey, name, CASE WHEN len(coalesce(tags, [])) = 0 THEN coalesce(new, tags) ELSE tags END AS tags FROM b LEFT JOIN s ON k = lower(name)""",
    "coerced_key_patch": """WITH r AS (SELECT o_orderkey AS k, CASE WHEN k % 3 = 0 AND k % 9 = 0 THEN 'not a date' WHEN k % 3 = 0 THEN '2001-02-03' WHEN k % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS released FROM orders)
        SELECT CAST(k AS VARCHAR) AS id, released, CAST(year(TRY_CAST(released AS DATE)) AS INT) AS year FROM r""",
    "two_hop_counts": """WITH o AS (SELECT l_orderkey AS code, min(p_partkey % 50) AS target FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY 1),
        c AS (SELECT l_suppkey % 40 AS target, count(*) AS listen_count FROM lineitem GROUP BY 1)
        SELECT o_orderkey AS code, o.target, coalesce(listen_count, 0) AS listen_count FROM orders LEFT JOIN o ON code = o_orderkey LEFT JOIN c ON c.target = o.target""",
    "lookup_by_id_else_name": """WITH n AS (SELECT p_name, p_brand, p_size AS by_name FROM part WHERE p_partkey % 7 = 0 QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey, p_size) = 1)
        SELECT p_partkey AS id, ' ' || upper(p.p_name) AS title, p.p_brand AS artist, CASE WHEN p_partkey % 7 = 0 THEN p_size ELSE by_name END AS peak
        FROM part p LEFT JOIN n ON n.p_name = p.p_name AND n.p_brand = p.p_brand""",
    "best_of_sources": """WITH u AS (SELECT p_partkey, p_size > 20 AS matched, p_brand AS isrc, NULL::VARCHAR AS second_id FROM part WHERE p_partkey % 2 = 0 UNION ALL
              SELECT p_partkey, p_size > 40, NULL, p_type FROM part WHERE p_partkey % 3 = 0)
        SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY matched DESC, isrc IS NOT NULL DESC, second_id IS NOT NULL DESC) = 1""",
    "artist_standing": f"""WITH {ROWS}, r AS (SELECT owner, count(DISTINCT pid) AS basket_count FROM rows WHERE owner IS NOT NULL GROUP BY 1),
        c AS (SELECT owner, item, title, count(DISTINCT pid) AS n FROM rows GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, item) AS r FROM c),
        tp AS (SELECT owner, string_agg(title, '; ' ORDER BY r) AS top_items FROM k WHERE r <= 3 GROUP BY 1),
        cu AS (SELECT p_brand AS owner, count(*) AS current FROM part GROUP BY 1)
        SELECT owner, basket_count, row_number() OVER (ORDER BY basket_count DESC, owner) AS rank, top_items, current FROM r JOIN tp USING (owner) LEFT JOIN cu USING (owner)""",
    "song_passport": f"""WITH {BASKETS}, n AS (SELECT l_partkey AS item, count(DISTINCT pid) AS basket_count, array_to_string(list(name ORDER BY name)[1:3], '|') AS top_names FROM lineitem JOIN baskets ON l_orderkey = pid GROUP BY 1)
        SELECT item, basket_count, round(basket_count * 100.0 / (SELECT count(DISTINCT pid) FROM baskets), 3) AS pct, top_names, CASE WHEN p_size > 10 THEN p_size END AS listens, replace(p_name, ' ', '|') AS genres, round(p_retailprice, 4) AS energy FROM n LEFT JOIN part ON p_partkey = item""",
    "playlist_profile": f"""WITH {TERMS}, w AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ') || ['zebra']) AS term FROM part)
        SELECT id, term, coalesce(n, 0) AS n FROM w LEFT JOIN terms USING (term)""",
    "title_roast": f"""WITH {TERMS}, sc AS (SELECT term, round(cume_dist() OVER (ORDER BY n) * 100, 1) AS score FROM terms),
        a AS (SELECT p_partkey AS id, [x for x in string_split(p_name, ' ') || CASE WHEN p_partkey % 2 = 0 THEN ['zebra'] ELSE []::VARCHAR[] END if length(x) > 2] AS ws FROM part),
        w AS (SELECT id, CAST(len(ws) AS INT) AS words, unnest(ws) AS term FROM a),
        g AS (SELECT id, words, count(score) AS known, round(sum(coalesce(score, 0.0)) / max(words), 1) AS genericness FROM w LEFT JOIN sc USING (term) GROUP BY 1, 2)
        SELECT *, CASE WHEN genericness >= 90 THEN 'indistinguishable' WHEN genericness >= 70 THEN 'common' WHEN genericness >= 50 THEN 'generic' WHEN genericness >= 30 THEN 'some originality' ELSE 'rare' END AS verdict FROM g""",
    "cluster_mode_labels": """WITH c AS (SELECT p_size % 7 AS cluster_id, p_name, count(*) AS n FROM part GROUP BY ALL),
        m AS (SELECT cluster_id, p_name FROM c QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, p_name) = 1),
        g AS (SELECT p_size % 7 AS cluster_id, round(avg(CAST(p_size AS DOUBLE)), 6) AS cx, round(avg(p_retailprice), 6) AS cy, count(*) AS size FROM part GROUP BY 1)
        SELECT cluster_id, array_to_string([upper(x[1]) || x[2:] for x in string_split(p_name, ' ')], ' ') AS label, cx, cy, size FROM g JOIN m USING (cluster_id)""",
    "unknown_mood": f"""WITH {BASKETS} SELECT regexp_matches(name, '(^|[^A-Za-z0-9_])high([^A-Za-z0-9_]|$)') AS is_mood, regexp_matches(name, '(^|[^A-Za-z0-9_])(sad|cry|heartbreak)([^A-Za-z0-9_]|$)') AS is_contrary, count(*) AS baskets FROM baskets GROUP BY ALL""",
    "most_common_share": f"""WITH {ROWS}, f AS (SELECT owner FROM rows) SELECT owner, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM f), 1) AS pct FROM f GROUP BY 1 ORDER BY n DESC, owner LIMIT 10""",
    "frequent_unmatched": """SELECT l_partkey AS item, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand < 'Brand#3') GROUP BY 1 HAVING count(*) >= 3""",
    "large_groups": """SELECT p_partkey AS item, p_name AS title FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) >= 4)""",
}
