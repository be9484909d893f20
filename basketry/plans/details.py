"""Queries for the details of profiles, standings, blends and lists, and for small forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import archive, graph, listening, quality, stats
from ..operators import matching as m
from . import archives as ar
from . import reach
from . import tables as t
from .tables import BASKETS, PLAYS, REACH, ROWS, edges_sql


def _edges(s, d):
    return graph.cooccurrence(t.basket_items(s, d), "pid", "node")


def _seeded(s, d, *seeds):
    return graph.seed_edges(t.basket_items(s, d), "pid", "node", seeds)


def _blend_items(s, d):
    rows = t.rows(s, d)
    return graph.blend_items(graph.blend(_seeded(s, d, 1, 2, 3), [1, 2, 3]), stats.top_items(rows, "node", "pid", "item", "title", 5))


def _main_character(s, d):
    items = t.basket_items(s, d)
    near = stats.top_neighbours(graph.symmetric(_edges(s, d)), t.supplier_reach(s, d), 8).select("owner", F.transform("neighbours", lambda x: x["neighbour"]).alias("neighbours"))
    listeners = t.table(s, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("owner"), F.floor("s_acctbal").cast("bigint").alias("listeners"))
    return stats.main_character(stats.reach_rank(items, "node", "pid"), near, listeners)


def _standings(s, d):
    ranked = stats.reach_rank(t.rows(s, d), "title", "pid").select(F.col("owner").alias("name"), "basket_count", "rank")
    full = ranked.where("rank <= 20")
    out = [m.standing(full, ranked, w).select(F.lit(w).alias("wanted"), "*") for w in ("RED WIDGET", "gizmo", "zz")]
    return out[0].unionAll(out[1]).unionAll(out[2])


def _uri(s, d):
    names = t.rows(s, d).groupBy(F.col("title").alias("name")).agg(F.countDistinct("pid").alias("basket_count"), F.min("item").alias("uri"))
    out = [m.resolve(names, w, uri=u).select(F.lit(w).alias("wanted"), "name", "basket_count", "uri") for w, u in (("red widget", 7), ("red widget", -1))]
    return out[0].unionAll(out[1].withColumn("wanted", F.lit("no uri")))


def _exact(s, d):
    parts = t.table(s, d, "part")
    asked = parts.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("!"), F.upper(F.replace("p_name", F.lit(" "), F.lit(" - "))))).otherwise("none such").alias("title"))
    return stats.exact_titles(parts.select(F.col("p_name").alias("name")), asked)


def _top_owner_rows(s, d):
    """Rows of the ten owners with most baskets, found by their lower-cased names, with the baskets' contexts."""
    top = stats.reach(t.rows(s, d), "owner", "pid").orderBy(F.desc("basket_count"), "owner").limit(10).select(F.upper("owner").alias("top"))
    flags = [F.col("name").rlike("|".join(words)).alias(c) for c, words in reach.CONTEXTS.items()]
    rows = t.rows(s, d).join(F.broadcast(top), F.lower("owner") == F.lower("top"))
    return stats.two_level_flags(rows.join(t.baskets(s, d).select("pid", *flags), "pid"), "owner", "pid", list(reach.CONTEXTS))


def _first_release(s, d):
    lines, orders, customer, nation = (t.table(s, d, x) for x in ("lineitem", "orders", "customer", "nation"))
    spine = t.items(s, d).join(lines, F.col("item") == F.col("l_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    spine = spine.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    spine = spine.select(F.concat_ws(" / ", "title", "n_name").alias("title"), "l_orderkey", F.year("o_orderdate").alias("year"))
    compilations = t.table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return m.min_excluding(spine, "title", "year", compilations, "l_orderkey", 1992, 2010)


def _default_rank(s, d):
    parts = t.table(s, d, "part")
    return stats.ranked_or_last(parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), parts.where("p_size > 25").select(F.col("p_name").alias("title"), F.col("p_partkey").cast("int").alias("rank")), "title", "rank")


def _filled(s, d):
    parts = t.table(s, d, "part")
    rows = parts.select("p_partkey", F.col("p_brand").alias("code"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("number"))
    return m.fill_by_map(rows, parts.where("p_size < 9").select(F.col("p_brand").alias("code"), F.col("p_size").alias("number")), "code", "number")


def _first_tag(s, d):
    parts = t.table(s, d, "part")
    tags = parts.where("p_size > 20").select(F.col("p_brand").alias("artist"), F.split("p_name", " ").alias("tags"), F.col("p_partkey").alias("rank"))
    return m.with_first_tag(parts.select("p_partkey", F.col("p_brand").alias("artist")), tags, "artist")


def _capsule(s, d):
    lines, orders = t.table(s, d, "lineitem"), t.table(s, d, "orders")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("playlist"), F.when(F.col("l_linenumber") < 4, F.to_date("o_orderdate")).alias("added"))
    names = t.table(s, d, "supplier").select(F.col("s_suppkey").alias("playlist"), F.col("s_name").alias("name"))
    return archive.named_capsule(rows, names, " SUPPLIER#00000000 ").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("added").alias("first_added"))


def _tag_only(s, d):
    parts = t.table(s, d, "part")
    tags = parts.groupBy(F.col("p_brand").alias("owner")).agg(F.array_distinct(F.flatten(F.collect_list(F.split("p_name", " ")))).alias("tags"))
    own = parts.where("p_brand < 'Brand#3'").select(F.upper("p_brand").alias("owner"))
    listeners = parts.groupBy(F.col("p_brand").alias("owner")).agg(F.sum(F.col("p_size").cast("bigint") * 100).alias("listeners"))
    return archive.tag_only(own, archive.habitat_scores(tags, ar.TAGS), listeners)


def _bits(s, d):
    flags = (F.col("p_partkey") % 8).cast("int")
    return t.table(s, d, "part").select("p_partkey", F.concat_ws(",", m.known_flags(flags, {"dump": 1, "slices": 2, "charts": 4})).alias("sources"))


def _ids(s, d):
    k = F.lpad(F.col("p_partkey").cast("string"), 22, "aB3")
    form = F.col("p_partkey") % 5
    address = F.when(form == 0, F.concat(F.lit("https://lists.example/playlist/"), k, F.lit("?si=1"))).when(form == 1, F.concat(F.lit("x:playlist:"), k)).when(form == 2, F.concat(F.lit(" "), k, F.lit(" "))).when(form == 3, F.concat(k, F.lit("x"))).otherwise("https://lists.example/track/9")
    names = F.concat(F.lit(" "), F.col("p_brand"), F.lit(", "), F.col("p_type"))
    return t.table(s, d, "part").select("p_partkey", text.list_id(address).alias("list_id"), text.url_to_uri(F.concat(F.lit("https://a.example/track/"), k, F.lit("?x=1#y"))).alias("uri"), text.first_name(names).alias("first"))


def _plays(s, d):
    return t.listens(s, d).withColumn("shuffle", F.when(F.col("type") != "signup", F.col("type") == "view")).withColumn("platform", F.when(F.col("type") != "error", F.col("type")))


def _removed_lists(s, d):
    ties = ["id", "playlist", "l_orderkey", "l_quantity", "l_extendedprice"]
    one, two = (archive.removed_list(ar._removed(s, d), by, 50, ties).select(F.lit(by).alias("sort"), "id", "playlist", "l_orderkey", "days_on", "date_removed") for by in ("recent", "longest"))
    return one.unionAll(two)


def _forensics(s, d):
    parts = t.table(s, d, "part")
    known = parts.select(F.col("p_brand").alias("list_id"), F.col("p_size").alias("num_tracks"))
    asked = parts.where("p_partkey < 12").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("title"), F.lit("").alias("artist"))
    reference = parts.where("p_size > 5").select(F.col("p_name").alias("r_title"), F.col("p_brand").alias("r_artist"))
    return m.known_or_forensics("Brand#11", known, asked, reference).unionAll(m.known_or_forensics("none", known, asked, reference))


def _sample(s, d):
    return quality.sample(t.table(s, d, "part").select("p_partkey", "p_name"), "p_partkey", 20)


def _choices(s, d):
    """JSON answers with and without fences, some with a value that is no choice."""
    k = F.col("p_partkey") % 4
    body = F.format_string('{"mood": "%s", "size": "%s"}', F.when(k == 1, "odd").otherwise("calm"), F.when(k == 2, "vast").otherwise("small"))
    fenced = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 3, "no json").otherwise(body)
    return t.table(s, d, "part").select("p_partkey", text.parsed_choice(fenced, {"mood": ["calm", "wild"], "size": ["small", "large"]}).alias("c")).select("p_partkey", "c.*")


QUERIES = {
    "group_blend_ground": lambda s, d: graph.common_ground(_seeded(s, d, 1, 2, 3), [1, 2, 3]),
    "group_blend_items": _blend_items,
    "collision_verdict": lambda s, d: graph.collision_verdict(_seeded(s, d, 1, 2), 1, 2),
    "main_character": _main_character,
    "standing_or_rank_only": _standings,
    "name_resolution_uri": _uri,
    "roast_exact_titles": _exact,
    "profile_top_artists": lambda s, d: stats.basket_owners(t.rows(s, d), "pid", "owner"),
    "profile_first_tracks": lambda s, d: stats.first_rows(t.rows(s, d).select("pid", "pos", "item", "title", "node"), "pid", ["pos", "item", "node"], 3),
    "habitat_top_owners": _top_owner_rows,
    "habitat_contexts": lambda s, d: stats.unpivot_flags(reach._habitat(s, d), list(reach.CONTEXTS)),
    "first_release_chain": _first_release,
    "default_rank": _default_rank,
    "fill_by_map": _filled,
    "first_tag_of_artist": _first_tag,
    "named_capsule": _capsule,
    "habitat_tag_only": _tag_only,
    "source_bits": _bits,
    "list_ids": _ids,
    "listening_top_detail": lambda s, d: listening.top_detail(_plays(s, d), "track"),
    "session_summary": lambda s, d: listening.session_summary(listening.sessions(t.listens(s, d))),
    "corpus_reference_summary": lambda s, d: listening.reference_summary(listening.corpus_reference(t.listens(s, d), t.supplier_reach(s, d).where("owner <> 3"))),
    "removed_lists": _removed_lists,
    "known_list_forensics": _forensics,
    "flag_report": lambda s, d: quality.flag_report(t.table(s, d, "part").withColumn("isrc", F.when(F.col("p_size") > 9, F.col("p_type"))), "p_size", ["p_name", "p_brand"], ["isrc", "p_name"]),
    "sampled_rows": _sample,
    "themed_terms": lambda s, d: text.themed(text.title_terms(t.part_titles(s, d), 20, 60), "OTHER", 10).select("term", "count", "theme"),
    "parsed_choices": _choices,
}

_DETAIL = f"{PLAYS}, dp AS (SELECT *, CASE WHEN type <> 'signup' THEN CAST(type = 'view' AS INT) END AS shuffle, CASE WHEN type <> 'error' THEN type END AS platform FROM plays)"
_FLAGS = ", ".join(f"CAST(regexp_matches(name, '{'|'.join(w)}') AS INT) AS {c}" for c, w in reach.CONTEXTS.items())
_FLAG_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}, round(sum({c}) * 100.0 / count(*), 2) AS {c}_pct" for c in reach.CONTEXTS)
_HABITAT = f"l AS (SELECT pid, {_FLAGS} FROM baskets), p AS (SELECT owner, pid, {', '.join(f'max({c}) AS {c}' for c in reach.CONTEXTS)} FROM rows JOIN l USING (pid) GROUP BY ALL), h AS (SELECT owner, count(*) AS basket_count, {_FLAG_SUMS} FROM p GROUP BY owner)"
_LADDER = "CASE WHEN pct >= 70 THEN 'high_reference_overlap' WHEN pct >= 40 THEN 'moderate_reference_overlap' WHEN pct >= 20 THEN 'some_reference_overlap' ELSE 'low_reference_overlap' END"

ORACLE = {
    "group_blend_ground": f"""WITH {edges_sql()}, p AS (SELECT dst, count(*) AS hits FROM both_ways WHERE src IN (1, 2, 3) GROUP BY 1),
        c AS (SELECT count(*) FILTER (dst NOT IN (1, 2, 3) AND hits = 3) AS f, count(*) FILTER (dst NOT IN (1, 2, 3)) AS h, count(*) AS neighbours FROM p)
        SELECT CASE WHEN f > 0 THEN f ELSE h END AS common, neighbours, round(CASE WHEN f > 0 THEN f ELSE h END * 100.0 / greatest(neighbours, 1), 1) AS pct FROM c""",
    "group_blend_items": f"""WITH {ROWS}, {edges_sql()}, b0 AS (SELECT dst, count(*) AS hits, sum(CAST(1.0 AS DOUBLE) / weight) AS inverse FROM both_ways WHERE src IN (1, 2, 3) AND dst NOT IN (1, 2, 3) GROUP BY 1),
        k AS (SELECT *, CASE WHEN hits = 3 THEN 3 / inverse ELSE 0.0 END AS h FROM b0 WHERE CASE WHEN (SELECT max(hits) FROM b0) = 3 THEN hits = 3 ELSE hits >= 1 END),
        bl AS (SELECT row_number() OVER (ORDER BY round(h, 6) DESC, dst) AS place, dst AS node, round(h / greatest((SELECT max(h) FROM k), 1.0), 3) AS blend_score FROM k ORDER BY place LIMIT 10),
        c AS (SELECT node, item, title, count(DISTINCT pid) AS n FROM rows GROUP BY ALL), ti AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, item) AS r FROM c QUALIFY r <= 2),
        a AS (SELECT place, node, title, blend_score, r, row_number() OVER (ORDER BY place, r) AS rank FROM bl JOIN ti USING (node)),
        s AS (SELECT place, min(rank) - 1 AS before FROM a GROUP BY 1)
        SELECT rank, title, node, blend_score FROM a JOIN s USING (place) WHERE before < 12""",
    "collision_verdict": f"""WITH {edges_sql()}, w AS (SELECT coalesce(max(weight), 0) AS shared FROM edges WHERE a = 1 AND b = 2)
        SELECT shared, (SELECT count(*) FROM both_ways x JOIN both_ways y ON x.dst = y.dst AND x.src = 1 AND y.src = 2 WHERE x.dst NOT IN (1, 2)) AS bridge_count,
            CASE WHEN shared >= 10000 THEN 'direct_collision' WHEN shared >= 2000 THEN 'frequent_proximity' WHEN shared >= 500 THEN 'occasional_contact' ELSE 'parallel_orbits' END AS verdict FROM w""",
    "main_character": f"""WITH {REACH}, {edges_sql()}, k AS (SELECT owner, row_number() OVER (ORDER BY basket_count DESC, owner) AS rank FROM reach),
        b AS (SELECT owner, rank, round((1 - (rank - 1) * 1.0 / (SELECT count(*) FROM k)) * 100, 1) AS basicness FROM k),
        r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM both_ways), n AS (SELECT src AS owner, list(dst ORDER BY r) AS neighbours FROM r WHERE r <= 5 GROUP BY 1)
        SELECT owner, rank, basicness, CASE WHEN basicness >= 90 THEN 'top_decile' WHEN basicness >= 75 THEN 'high_reach' WHEN basicness >= 50 THEN 'above_median_reach' ELSE 'focused_reach' END AS status,
            neighbours, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(floor(s_acctbal) AS BIGINT) END AS listeners FROM b LEFT JOIN n USING (owner) LEFT JOIN supplier ON s_suppkey = owner""",
    "standing_or_rank_only": f"""WITH {ROWS}, c AS (SELECT title AS name, count(DISTINCT pid) AS basket_count FROM rows GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY basket_count DESC, name) AS rank FROM c),
        w(wanted) AS (VALUES ('RED WIDGET'), ('gizmo'), ('zz')), x AS (SELECT *, CASE WHEN lower(name) = lower(wanted) THEN 0 WHEN contains(lower(name), lower(wanted)) AND length(wanted) >= 3 THEN 1 END AS prio FROM k, w),
        f AS (SELECT * FROM x WHERE prio IS NOT NULL AND rank <= 20 QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY prio, basket_count DESC, name) = 1),
        s AS (SELECT * FROM x WHERE prio IS NOT NULL QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY prio, rank, name) = 1)
        SELECT wanted, name, basket_count, rank, 'full' AS detail_level FROM f UNION ALL SELECT wanted, name, basket_count, rank, 'rank_only' FROM s WHERE wanted NOT IN (SELECT wanted FROM f)""",
    "name_resolution_uri": f"""WITH {ROWS}, n AS (SELECT title AS name, count(DISTINCT pid) AS basket_count, min(item) AS uri FROM rows GROUP BY 1), x AS (SELECT *, CASE WHEN name = 'red widget' THEN 0 WHEN contains(name, 'red widget') THEN 1 END AS prio FROM n),
        o AS (SELECT 'red widget' AS wanted, *, CASE WHEN uri = 7 THEN -1 ELSE prio END AS p FROM x UNION ALL SELECT 'no uri', *, prio FROM x)
        SELECT wanted, name, basket_count, uri FROM o WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY p, basket_count DESC, name) = 1""",
    "roast_exact_titles": """WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1)
        SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p.p_name ELSE 'none such' END AS title_key, CASE WHEN p_partkey % 2 = 0 THEN n ELSE 0 END AS exact_count,
            CASE WHEN p_partkey % 2 = 0 THEN [p.p_name] ELSE []::VARCHAR[] END AS examples FROM part p JOIN c ON c.p_name = p.p_name""",
    "profile_top_artists": f"""WITH {ROWS}, c AS (SELECT pid, owner, count(*) AS n, sum(count(*)) OVER (PARTITION BY pid) AS whole FROM rows GROUP BY 1, 2)
        SELECT pid, owner, n, round(n * 100.0 / CAST(whole AS BIGINT), 1) AS pct FROM c WHERE owner IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pid ORDER BY n DESC, owner) <= 10""",
    "profile_first_tracks": f"WITH {ROWS} SELECT pid, pos, item, title, node FROM rows QUALIFY row_number() OVER (PARTITION BY pid ORDER BY pos, item, node) <= 3",
    "habitat_top_owners": f"""WITH {ROWS}, {BASKETS}, {_HABITAT}, tp AS (SELECT owner FROM rows GROUP BY 1 ORDER BY count(DISTINCT pid) DESC, owner LIMIT 10) SELECT * FROM h WHERE owner IN (SELECT owner FROM tp)""",
    "habitat_contexts": f"WITH {ROWS}, {BASKETS}, {_HABITAT} " + " UNION ALL ".join(f"SELECT owner, '{c}' AS context, {c} AS count, {c}_pct AS pct FROM h" for c in reach.CONTEXTS),
    "first_release_chain": """SELECT p_name || ' / ' || n_name AS title, CAST(min(year(o_orderdate)) AS INT) AS first_year FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority <> '1-URGENT' GROUP BY 1 HAVING min(year(o_orderdate)) BETWEEN 1992 AND 2010""",
    "default_rank": """WITH r AS (SELECT p_name, CAST(min(p_partkey) AS INT) AS rank FROM part WHERE p_size > 25 GROUP BY 1)
        SELECT p_partkey AS id, p.p_name AS title, coalesce(rank, 2147483647) AS rank FROM part p LEFT JOIN r ON r.p_name = p.p_name""",
    "fill_by_map": """WITH n AS (SELECT p_brand, min(p_size) AS new FROM part WHERE p_size < 9 GROUP BY 1)
        SELECT p_partkey, p.p_brand AS code, coalesce(CASE WHEN p_size > 25 THEN p_size END, new) AS number FROM part p LEFT JOIN n ON n.p_brand = p.p_brand""",
    "first_tag_of_artist": """WITH o AS (SELECT p_brand, string_split(p_name, ' ')[1] AS top_tag FROM part WHERE p_size > 20 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1)
        SELECT p_partkey, p.p_brand AS artist, top_tag FROM part p LEFT JOIN o ON o.p_brand = p.p_brand""",
    "named_capsule": """SELECT l_partkey AS id, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first_added FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
        WHERE l_linenumber < 4 AND contains(lower(s_name), 'supplier#00000000') GROUP BY 1""",
    "habitat_tag_only": f"""WITH tags AS (SELECT p_brand AS owner, list_distinct(flatten(list(string_split(p_name, ' ')))) AS tags, sum(p_size) * 100 AS listeners FROM part WHERE p_brand >= 'Brand#3' GROUP BY 1),
        sc AS ({ar._TAGS_SQL}) SELECT owner, CAST(listeners // 1000 AS BIGINT) AS basket_count, context, score AS pct FROM sc JOIN tags USING (owner) WHERE owner IN (SELECT owner FROM sc WHERE score > 0)""",
    "source_bits": """SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey & 1 <> 0 THEN 'dump' END, CASE WHEN p_partkey & 2 <> 0 THEN 'slices' END, CASE WHEN p_partkey & 4 <> 0 THEN 'charts' END) AS sources FROM part""",
    "list_ids": """WITH k AS (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 22, 'aB3') AS k FROM part)
        SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN k END AS list_id, 'track:' || k AS uri, p_brand AS first FROM k""",
    "listening_top_detail": f"""WITH {_DETAIL}, b AS (SELECT track, CAST(sum(ms) AS BIGINT) AS ms, count(*) AS plays, round(avg(shuffle), 4) AS shuffle_rate, count(DISTINCT CAST(ts AS DATE)) AS active_days FROM dp GROUP BY 1 ORDER BY ms DESC, track LIMIT 10),
        pf AS (SELECT track, platform, count(*) AS n FROM dp WHERE platform IS NOT NULL GROUP BY track, platform QUALIFY row_number() OVER (PARTITION BY track ORDER BY n DESC, platform) = 1)
        SELECT b.*, platform, round(ms / active_days, 1) AS ms_per_day FROM b LEFT JOIN pf USING (track)""",
    "session_summary": f"""WITH {PLAYS}, g AS (SELECT *, coalesce(CAST(ts > lag(ts) OVER w + INTERVAL 30 MINUTE AS INT), 1) AS new FROM plays WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
        e AS (SELECT user_id, session, CAST(date_sub('microsecond', min(ts), max(ts)) // 60000000 AS BIGINT) AS minutes FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) AS sessions, CAST(quantile_cont(minutes, 0.5) AS DOUBLE) AS median_minutes, max(minutes) AS longest_minutes FROM e GROUP BY 1""",
    "corpus_reference_summary": f"""WITH {PLAYS}, {REACH}, b AS (SELECT artist FROM plays GROUP BY 1 ORDER BY sum(ms) DESC, artist LIMIT 8)
        SELECT count(*) AS total, count(owner) AS matched, round(avg(basket_count), 3) AS mean_reach FROM b LEFT JOIN (SELECT * FROM reach WHERE owner <> 3) ON owner = artist""",
    "removed_lists": f"""WITH {ar._REMOVED}, x AS (SELECT 'recent' AS sort, * FROM removed ORDER BY date_removed DESC NULLS LAST, id, playlist, l_orderkey, l_quantity, l_extendedprice LIMIT 50),
        y AS (SELECT 'longest' AS sort, * FROM removed ORDER BY days_on DESC NULLS LAST, id, playlist, l_orderkey, l_quantity, l_extendedprice LIMIT 50)
        SELECT sort, id, playlist, l_orderkey, days_on, date_removed FROM (FROM x UNION ALL FROM y)""",
    "known_list_forensics": f"""WITH q AS (SELECT p_partkey, lower(p_name) AS title FROM part WHERE p_partkey < 12), k AS (SELECT CAST(max(p_size) AS BIGINT) AS n FROM part WHERE p_brand = 'Brand#11'),
        h AS (SELECT (SELECT count(DISTINCT q.p_partkey) FROM part p JOIN q ON contains(lower(p.p_name), title) WHERE p.p_size > 5) AS hits, (SELECT count(*) FROM q) AS total), p AS (SELECT *, round(hits * 100.0 / greatest(total, 1), 0) AS pct FROM h)
        SELECT n AS hits, n AS total, CAST(100.0 AS DOUBLE) AS pct, 'known_editorial_playlist' AS verdict FROM k UNION ALL SELECT hits, total, pct, {_LADDER} FROM p""",
    "flag_report": """WITH c AS (SELECT *, count(*) OVER (PARTITION BY p_name, p_brand) AS again FROM part)
        SELECT p_size, count(*) AS rows, count(*) FILTER (again > 1) AS repeated, count(*) FILTER (p_size <= 9 OR p_type IS NULL) AS null_isrc, count(*) FILTER (p_name IS NULL) AS null_p_name FROM c GROUP BY 1""",
    "themed_terms": f"WITH {ar._TERM_ROWS} SELECT term, count, theme FROM trows WHERE theme = 'other' ORDER BY count DESC, term LIMIT 10",
    "parsed_choices": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'calm' WHEN 2 THEN 'calm' END AS mood, CASE p_partkey % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'small' END AS size FROM part""",
}
