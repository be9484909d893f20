"""Record matching and merging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import matching as m
from . import tables as t
from .tables import ROWS

YEAR = "CAST(year(o_orderdate) AS INT)"


def _spine(s, d):
    docs, labels = t.table(s, d, "documents"), t.table(s, d, "labels")
    return m.merge_identities(docs.select("doc_id", "source", F.lit(None).cast("int").alias("quality")), labels.select("doc_id", F.lit(None).cast("string").alias("source"), "quality"), "doc_id", ["source", "quality"])


def _patch(s, d):
    parts = t.table(s, d, "part")
    base = parts.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, None).otherwise(F.col("p_size")).alias("size"))
    return m.patch(base, parts.where("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") + 100).alias("size")), "p_partkey", ["size"])


def _backfill(s, d):
    parts = t.table(s, d, "part")
    k = F.col("p_partkey") % 5
    base = parts.select("p_partkey", F.when(k == 0, None).when(k == 1, "  ").when(k == 2, "Artist").otherwise(F.col("p_brand")).alias("artist"))
    one = parts.where("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.concat(F.lit("one "), "p_brand")).alias("artist"))
    two = parts.where("p_partkey % 7 <> 0").select("p_partkey", F.concat(F.lit("two "), "p_brand").alias("artist"))
    return m.backfill(base, [one, two], "p_partkey", "artist", "artist")


def _append(s, d):
    parts = t.table(s, d, "part")
    base = parts.where("p_size < 20").select("p_partkey", "p_name")
    return m.append_new(base, parts.where("p_size BETWEEN 10 AND 30").select("p_partkey", "p_name", "p_type"), "p_partkey")


def _orphans(s, d):
    o = t.table(s, d, "orders").select(F.col("o_orderkey").alias("key"))
    return m.orphans(o, t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


def _key_match(s, d):
    parts = t.table(s, d, "part").withColumn("key", text.match_key(F.col("p_name"), F.col("p_brand")))
    first = m.keep_first(parts, ["key"], [F.desc("p_size"), F.desc("p_retailprice"), F.col("p_partkey")])
    return parts.select("p_partkey", "key").join(first.select("key", F.col("p_partkey").alias("match_id"), "p_size"), "key")


def _two_stage(s, d):
    parts = t.table(s, d, "part")
    wanted = parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    known = parts.where("p_size > 40").select(F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), "p_retailprice")
    return m.two_stage(wanted, known, ["title", "artist"], "artist", "p_retailprice")


def _first_year(s, d):
    spine = t.table(s, d, "lineitem").join(t.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    spine = spine.select(F.col("l_partkey").alias("item"), "l_orderkey", F.year("o_orderdate").alias("year"))
    late = t.table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return m.min_excluding(spine, "item", "year", late, "l_orderkey", 1996, 2001)


def _substring(s, d):
    docs = t.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return m.substring_hits(docs, t.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


def _forensics(s, d):
    parts = t.table(s, d, "part")
    asked = parts.where("p_partkey < 12").select(F.col("p_partkey").alias("query_id"), F.split("p_name", " ")[1].alias("title"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_brand")).alias("artist"))
    return m.forensics(asked, parts.select(F.col("p_name").alias("r_title"), F.col("p_brand").alias("r_artist")))


def _titles(s, d):
    return t.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), (F.col("p_partkey") * 7919 % 1009).alias("rank"))


def _passport(s, d):
    counts = t.rows(s, d).groupBy("item", "title", "owner").agg(F.countDistinct("pid").alias("basket_count"))
    return m.passport(counts, "Red Widget")


def _resolve(s, d):
    names = t.rows(s, d).groupBy(F.col("title").alias("name")).agg(F.countDistinct("pid").alias("basket_count"))
    out = None
    for wanted in ("RED WIDGET", "gizmo", "re"):
        one = m.resolve(names, wanted).select(F.lit(wanted).alias("wanted"), "name", "basket_count")
        out = one if out is None else out.unionAll(one)
    return out


def _best_record(s, d):
    lines = t.table(s, d, "lineitem")
    order = [F.desc(F.col("l_returnflag") == "R"), F.desc("l_quantity"), F.desc("l_extendedprice"), F.col("l_suppkey"), F.col("l_discount"), F.col("l_tax"), F.col("l_shipdate"), F.col("l_linestatus")]
    return m.keep_first(lines, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")


def _sets(s, d):
    parts = t.table(s, d, "part")
    key = lambda df: df.select(text.canonical(F.concat_ws(" ", "p_name", "p_brand")).alias("key")).distinct()
    a, b = key(parts.where("p_size < 25")), key(parts.where("p_size > 15"))
    n = lambda df, name: df.select(F.count(F.lit(1)).alias(name))
    counts = n(a, "ours").crossJoin(n(b, "theirs")).crossJoin(n(a.intersect(b), "common")).crossJoin(n(b.exceptAll(a), "missing")).crossJoin(n(a.union(b).distinct(), "either"))
    return counts.withColumn("overlap_pct", F.round(F.col("common") * 100.0 / F.greatest("theirs", F.lit(1)), 2))


def _variants(s, d):
    names = t.rows(s, d).groupBy(F.col("title").alias("name")).agg(F.countDistinct("pid").alias("basket_count"))
    found = [m.resolve_pattern(names, w).select(F.lit(w).alias("wanted"), "name", "basket_count") for w in ("r.d", "GIZMO", "t")]
    return found[0].unionAll(found[1]).unionAll(found[2])


def _candidates(s, d):
    parts = t.table(s, d, "part")
    asked = parts.select(F.upper("p_name").alias("title"), F.col("p_brand").alias("artist"), (F.col("p_partkey") % 17).cast("double").alias("fit"))
    known = parts.select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("title"), F.lower("p_brand").alias("artist"))
    features = parts.where("p_size > 10").select(F.col("p_partkey").alias("uri"), (F.col("p_size") / 50).alias("energy"), F.round((F.col("p_retailprice") - 900) / 100, 4).alias("valence"))
    return m.qualified_candidates(asked, known, features)


QUERIES = {
    "variant_resolver": _variants,
    "candidate_dedup_qualify": _candidates,
    "spine_full_outer_flags": _spine,
    "coalesce_patch": _patch,
    "blank_backfill_flags": _backfill,
    "append_new_only": _append,
    "orphan_audit": _orphans,
    "key_match_first_wins": _key_match,
    "two_stage_match": _two_stage,
    "min_year_excluding": _first_year,
    "substring_hits": _substring,
    "substring_forensics": _forensics,
    "prefix_search_rank": lambda s, d: m.search(_titles(s, d), "re"),
    "passport_ambiguity": _passport,
    "name_resolution": _resolve,
    "best_record_first": _best_record,
    "set_overlap": _sets,
}

ORACLE = {
    "variant_resolver": f"""WITH {ROWS}, n AS (SELECT title AS name, count(DISTINCT pid) AS basket_count FROM rows GROUP BY 1), w(wanted) AS (VALUES ('r.d'), ('GIZMO'), ('t')),
        x AS (SELECT *, CASE WHEN lower(name) = lower(wanted) THEN 0 WHEN regexp_matches(lower(name), lower(wanted)) THEN 1 END AS prio FROM n, w)
        SELECT wanted, name, basket_count FROM x WHERE prio IS NOT NULL QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY prio, basket_count DESC, name) = 1""",
    "candidate_dedup_qualify": """WITH j AS (SELECT v.p_partkey AS uri, upper(c.p_name) AS title, c.p_brand AS artist, CAST(c.p_partkey % 17 AS DOUBLE) AS fit, v.p_size / 50 AS energy, round((v.p_retailprice - 900) / 100, 4) AS valence
            FROM part c JOIN part v ON lower(c.p_name) = lower(v.p_name) AND lower(c.p_brand) = lower(v.p_brand) WHERE v.p_size > 10),
        o AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY uri ORDER BY fit DESC, artist, title) = 1)
        SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY artist ORDER BY fit DESC, uri) <= 5""",
    "spine_full_outer_flags": """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.source, l.quality,
            CAST((CASE WHEN d.doc_id IS NOT NULL THEN 1 ELSE 0 END) | (CASE WHEN l.doc_id IS NOT NULL THEN 4 ELSE 0 END) AS INT) AS source_flags,
            CASE WHEN d.doc_id IS NULL THEN 'b_only' WHEN l.doc_id IS NULL THEN 'a_only' ELSE 'a+b' END AS match_method,
            md5(CAST(coalesce(d.doc_id, l.doc_id) AS VARCHAR)) AS canonical_id
        FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
    "coalesce_patch": """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size WHEN p_partkey % 2 = 0 THEN p_size + 100 END AS size FROM part""",
    "blank_backfill_flags": """WITH b AS (SELECT p_partkey, p_brand, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'Artist' ELSE p_brand END AS artist,
            CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 <> 0 THEN 'one ' || p_brand END AS one, CASE WHEN p_partkey % 7 <> 0 THEN 'two ' || p_brand END AS two FROM part),
        f AS (SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN coalesce(one, two, artist) ELSE artist END AS artist FROM b)
        SELECT p_partkey, artist, lower(trim(coalesce(artist, ''))) IN ('', 'artist') AS needs_metadata FROM f""",
    "append_new_only": """SELECT p_partkey, p_name, NULL::VARCHAR AS p_type FROM part WHERE p_size < 20 UNION ALL
        SELECT p_partkey, p_name, p_type FROM part WHERE p_size BETWEEN 20 AND 30""",
    "orphan_audit": """SELECT DISTINCT 'left' AS side, o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL
        SELECT DISTINCT 'right', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
    "key_match_first_wins": """WITH k AS (SELECT *, lower(trim(p_name)) || '|||' || lower(trim(p_brand)) AS key FROM part),
        f AS (SELECT key, p_partkey AS match_id, p_size FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY p_size DESC, p_retailprice DESC, p_partkey) = 1)
        SELECT k.p_partkey, key, match_id, f.p_size FROM k JOIN f USING (key)""",
    "two_stage_match": """WITH e AS (SELECT p_name AS title, p_brand AS artist, max(p_retailprice) AS value FROM part WHERE p_size > 40 GROUP BY ALL),
        f AS (SELECT p_brand AS artist, round(avg(p_retailprice), 2) AS value FROM part WHERE p_size > 40 GROUP BY 1)
        SELECT p_partkey AS id, p_name AS title, p_brand AS artist, coalesce(e.value, f.value) AS value, CASE WHEN e.value IS NULL THEN 'fallback' ELSE 'exact' END AS match_type
        FROM part LEFT JOIN e ON e.title = p_name AND e.artist = p_brand LEFT JOIN f ON f.artist = p_brand WHERE coalesce(e.value, f.value) IS NOT NULL""",
    "min_year_excluding": """SELECT l_partkey AS item, CAST(min(year(o_orderdate)) AS INT) AS first_year FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING min(year(o_orderdate)) BETWEEN 1996 AND 2001""",
    "substring_hits": """SELECT item_id AS query_id, count(DISTINCT doc_id) AS hits FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE b.text <> '' GROUP BY 1""",
    "substring_forensics": """WITH q AS (SELECT p_partkey AS query_id, string_split(p_name, ' ')[2] AS title, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS artist FROM part WHERE p_partkey < 12),
        h AS (SELECT count(DISTINCT query_id) AS hits FROM part JOIN q ON contains(lower(p_name), lower(title)) AND (artist = '' OR contains(lower(p_brand), lower(artist)))),
        r AS (SELECT hits, (SELECT count(*) FROM q) AS total FROM h), p AS (SELECT *, round(hits * 100.0 / greatest(total, 1), 0) AS pct FROM r)
        SELECT *, CASE WHEN pct >= 70 THEN 'high_reference_overlap' WHEN pct >= 40 THEN 'moderate_reference_overlap' WHEN pct >= 20 THEN 'some_reference_overlap' ELSE 'low_reference_overlap' END AS verdict FROM p""",
    "prefix_search_rank": """WITH t AS (SELECT p_partkey AS id, p_name AS title, p_brand AS artist, p_partkey * 7919 % 1009 AS rank, CAST(CASE WHEN starts_with(p_name, 're') THEN 0 ELSE 1 END AS INT) AS prio FROM part WHERE contains(p_name, 're')),
        o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY title, artist ORDER BY prio, rank, id) = 1)
        SELECT * FROM o ORDER BY prio, rank, id LIMIT 10""",
    "passport_ambiguity": f"""WITH {ROWS}, f AS (SELECT item, title, owner, count(DISTINCT pid) AS basket_count FROM rows WHERE lower(title) = 'red widget' GROUP BY ALL)
        SELECT *, (SELECT count(DISTINCT owner) FROM f) > 1 AS ambiguous FROM f""",
    "name_resolution": f"""WITH {ROWS}, n AS (SELECT title AS name, count(DISTINCT pid) AS basket_count FROM rows GROUP BY 1),
        w AS (SELECT unnest(['RED WIDGET', 'gizmo', 're']) AS wanted),
        c AS (SELECT wanted, name, basket_count, CASE WHEN lower(name) = lower(wanted) THEN 0 WHEN contains(lower(name), lower(wanted)) AND length(wanted) >= 3 THEN 1 END AS prio FROM w, n)
        SELECT wanted, name, basket_count FROM c WHERE prio IS NOT NULL QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY prio, basket_count DESC, name) = 1""",
    "best_record_first": """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag = 'R' DESC, l_quantity DESC, l_extendedprice DESC, l_suppkey, l_discount, l_tax, l_shipdate, l_linestatus) = 1""",
    "set_overlap": """WITH k AS (SELECT DISTINCT lower(p_name || ' ' || regexp_replace(p_brand, '[^A-Za-z0-9_ ]', '', 'g')) AS key, p_size FROM part),
        a AS (SELECT DISTINCT key FROM k WHERE p_size < 25), b AS (SELECT DISTINCT key FROM k WHERE p_size > 15),
        n AS (SELECT (SELECT count(*) FROM a) AS ours, (SELECT count(*) FROM b) AS theirs, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS common,
              (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS missing, (SELECT count(*) FROM (FROM a UNION FROM b)) AS either)
        SELECT *, round(common * 100.0 / greatest(theirs, 1), 2) AS overlap_pct FROM n""",
}
