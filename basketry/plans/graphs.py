"""Graph queries over the suppliers that share orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from . import tables as t
from .tables import REACH, edges_sql


def _edges(s, d):
    return graph.cooccurrence(t.basket_items(s, d), "pid", "node")


def _seeded(s, d, *seeds):
    """The edges of a few nodes, found from their baskets."""
    return graph.seed_edges(t.basket_items(s, d), "pid", "node", seeds)


def _tags(s, d):
    parts = t.table(s, d, "part")
    return parts.select(F.col("p_brand").alias("owner"), F.explode(F.array_union(F.split("p_name", " "), F.array("p_type"))).alias("tag")).distinct()


def _ancestry(s, d):
    reach = t.rows(s, d).groupBy("owner").agg(F.countDistinct("pid").alias("basket_count"))
    return graph.tag_ancestry(_tags(s, d), reach, "Brand#11")


QUERIES = {
    "edge_endpoints": lambda s, d: graph.endpoints(_edges(s, d)),
    "cooccurrence_edges": lambda s, d: graph.cooccurrence(t.basket_items(s, d), "pid", "node", 2, 50),
    "compass_neighbors": lambda s, d: graph.compass(_seeded(s, d, 1), 1),
    "overlap_arena": lambda s, d: graph.overlap(_seeded(s, d, 1, 2, 3, 4, 5, 7), t.supplier_reach(s, d), [(1, 2), (3, 7), (5, 4)]),
    "collision_bridges": lambda s, d: graph.collision(_seeded(s, d, 1, 2), t.supplier_reach(s, d), 1, 2),
    "group_blend": lambda s, d: graph.blend(_seeded(s, d, 1, 2, 3), [1, 2, 3]),
    "six_degrees_paths": lambda s, d: graph.six_degrees(s, _edges(s, d), 1, 9, 4, 8),
    "tag_jaccard_ancestry": _ancestry,
}

ORACLE = {
    "edge_endpoints": f"WITH {edges_sql()} SELECT a AS node FROM edges UNION SELECT b FROM edges",
    "cooccurrence_edges": f"WITH {edges_sql(2, 50)} SELECT a, b, weight FROM edges",
    "compass_neighbors": f"""WITH {edges_sql()}, r AS (SELECT dst AS neighbour, weight FROM both_ways WHERE src = 1 ORDER BY weight DESC, dst LIMIT 12)
        SELECT neighbour, weight, round(weight * 1.0 / max(weight) OVER (), 3) AS strength FROM r""",
    "overlap_arena": f"""WITH {REACH}, {edges_sql()}, o AS (SELECT a, b, weight AS shared, round(weight * 100.0 / greatest(least(x.basket_count, y.basket_count), 1), 2) AS overlap_pct
            FROM edges JOIN reach x ON x.owner = a JOIN reach y ON y.owner = b WHERE (a = 1 AND b = 2) OR (a = 3 AND b = 7) OR (a = 4 AND b = 5))
        SELECT *, CASE WHEN overlap_pct >= 30 THEN 'highly_entangled' WHEN overlap_pct >= 15 THEN 'frequent_companions' WHEN overlap_pct >= 5 THEN 'occasional_neighbors' ELSE 'parallel_universes' END AS verdict FROM o""",
    "collision_bridges": f"""WITH {REACH}, {edges_sql()}
        SELECT x.dst AS bridge, x.weight AS wa, y.weight AS wb, round(CAST(2.0 AS DOUBLE) * x.weight * y.weight / (x.weight + y.weight), 1) AS score, basket_count
        FROM both_ways x JOIN both_ways y ON x.dst = y.dst AND x.src = 1 AND y.src = 2 JOIN reach ON owner = x.dst WHERE x.dst NOT IN (1, 2)
        ORDER BY score DESC, basket_count DESC, bridge LIMIT 8""",
    "group_blend": f"""WITH {edges_sql()}, p AS (SELECT dst, count(*) AS hits, sum(CAST(1.0 AS DOUBLE) / weight) AS inverse FROM both_ways WHERE src IN (1, 2, 3) AND dst NOT IN (1, 2, 3) GROUP BY 1),
        k AS (SELECT *, CASE WHEN hits = 3 THEN 3 / inverse ELSE 0.0 END AS h FROM p WHERE CASE WHEN (SELECT max(hits) FROM p) = 3 THEN hits = 3 ELSE hits >= 1 END)
        SELECT row_number() OVER (ORDER BY round(h, 6) DESC, dst) AS place, dst AS node, hits, round(h / greatest((SELECT max(h) FROM k), 1.0), 3) AS blend_score FROM k ORDER BY place LIMIT 10""",
    "six_degrees_paths": f"""WITH RECURSIVE {edges_sql()},
        s AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM both_ways) WHERE r <= 8),
        walk AS (SELECT CAST(1 AS BIGINT) AS node, [CAST(1 AS BIGINT)] AS path UNION ALL
                 SELECT dst, list_append(path, dst) FROM walk JOIN s ON src = node WHERE len(path) <= 4 AND NOT list_contains(path, dst) AND node <> 9),
        best AS (SELECT path FROM walk WHERE node = 9 ORDER BY len(path), path LIMIT 1),
        hops AS (SELECT unnest(range(len(path))) AS hop, path FROM best)
        SELECT hop, path[hop + 1] AS node, weight AS shared FROM hops LEFT JOIN both_ways ON src = path[hop] AND dst = path[hop + 1]""",
    "tag_jaccard_ancestry": """WITH tags AS (SELECT DISTINCT p_brand AS owner, unnest(string_split(p_name, ' ') || [p_type]) AS tag FROM part),
        own AS (SELECT tag FROM tags WHERE owner = 'Brand#11'),
        sizes AS (SELECT owner, count(*) AS size FROM tags GROUP BY 1),
        reach AS (SELECT p_brand AS owner, count(DISTINCT l_orderkey) AS basket_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
        c AS (SELECT owner, count(*) AS common, list(tag ORDER BY tag)[1:4] AS shared_tags FROM tags JOIN own USING (tag) WHERE owner <> 'Brand#11' GROUP BY 1),
        sc AS (SELECT owner, shared_tags, basket_count, round(common * 1.0 / (size + (SELECT count(*) FROM own) - common), 4) AS similarity
               FROM c JOIN sizes USING (owner) JOIN reach USING (owner) WHERE common * 1.0 / (size + (SELECT count(*) FROM own) - common) >= 0.05 ORDER BY similarity DESC, owner LIMIT 60),
        b AS (SELECT basket_count AS base FROM reach WHERE owner = 'Brand#11'),
        x AS (SELECT *, CASE WHEN basket_count > 1.2 * base THEN 'ancestor' WHEN basket_count < 0.8 * base THEN 'descendant' ELSE 'peer' END AS side FROM sc, b),
        y AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY similarity DESC, owner) AS r FROM x)
        SELECT owner, similarity, shared_tags, CASE WHEN r > 5 THEN 'peer' ELSE side END AS side FROM y""",
}
