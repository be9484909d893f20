"""Vector, route, quality and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import maps, neighbours, search_index, skipgram
from ..operators import quality as q
from ..operators import vectors as v
from ..session import checkpoint_dir, delete
from . import tables as t


def _vectors(s, d):
    return t.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("owner"), F.col("embedding").alias("vector"))


def _top(s, d):
    vectors = _vectors(s, d).select("id", "vector")
    return v.top_k(vectors, vectors.where("id % 100 = 0").toDF("query_id", "query"), 10)


def _doppelganger(s, d):
    parts = t.table(s, d, "part").select((F.col("p_partkey") % 10).cast("int").alias("owner"), F.explode(F.split("p_name", " ")).alias("tag"))
    tags = parts.groupBy("owner").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return v.doppelganger(_vectors(s, d), tags, 3)


def _soundtrack(s, d):
    p = t.table(s, d, "part")
    c = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("artist"), (F.col("p_size") / 50).alias("energy"), ((F.col("p_retailprice") - 900) / 100).alias("valence"), (F.col("p_partkey") % 17).cast("double").alias("fit"))
    return v.soundtrack(s, c, "a rainy late-night drive")


def _clusters(s, d):
    vectors = _vectors(s, d)
    return v.cluster_labels(v.map_clusters(vectors.select("id", "vector")), vectors.select("id", F.concat(F.lit("genre "), "owner").alias("label")))


def _names(s, d):
    terms = text.title_terms(t.part_titles(s, d), 1, 500)
    return v.generate_names(s, terms, "all", 8)


def _labelled(s, d):
    return t.table(s, d, "documents").join(t.table(s, d, "labels"), "doc_id", "left").select("doc_id", "text", "source", "quality", "toxic")


def _search(s, d):
    ranks = t.table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7919 % 1009).alias("rank"))
    return q.search(q.inverted_index(t.part_titles(s, d).select("id", F.col("name").alias("text"))), ranks, "Red widget")


def _guard(s, d):
    titles = t.table(s, d, "part").select(F.when(F.col("p_partkey") % 40 == 0, " ").otherwise(F.col("p_name")).alias("name"))
    return q.blank_guard(titles, "name")


def _lists(s, d):
    """The ten vectors most like each one whose id is divisible by 100, by lists; the vector itself comes first."""
    vectors = _vectors(s, d).select("id", "vector")
    index, centres = v.list_index(vectors)
    return v.search_lists(index, centres, vectors.where("id % 100 = 0").toDF("query_id", "query"), 10)


def _at(s, name: str) -> str:
    """A folder for what a query stores, emptied of what its last run left."""
    path = f"{checkpoint_dir(s)}/stored-{s.sparkContext.applicationId}/{name}"
    delete(s, path)
    return path


def _graph_search(s, d):
    """The ten vectors most like each one whose id is divisible by 100, by the stored graph index; the vector itself comes first."""
    vectors, at = _vectors(s, d).select("id", "vector"), _at(s, "graph")
    neighbours.build(vectors, f"{at}/index")
    return neighbours.search(s, f"{at}/index", vectors.where("id % 100 = 0").toDF("query_id", "query"), f"{at}/found").drop("compared")


def _orders(s, d):
    rows = t.basket_items(s, d).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("x"))
    return rows.select(F.col("pid").alias("sequence"), F.transform("x", lambda e: e["item"].cast("string")).alias("tokens"))


def _document_index(s, d) -> str:
    path = _at(s, "documents")
    search_index.store(t.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), path)
    return path


def _document_search(s, d, query: str, prefix: bool):
    ranks = t.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("rank"))
    return search_index.search(s, _document_index(s, d), ranks, query, 20, prefix)


QUERIES = {
    "search_index_tokens": lambda s, d: search_index.tokens(s, _document_index(s, d)),
    "search_index_words": lambda s, d: _document_search(s, d, "The and OF", False),
    "search_index_prefix": lambda s, d: _document_search(s, d, "the wo", True),
    "vector_graph_search": _graph_search,
    "neighbour_map": lambda s, d: maps.neighbour_map(_vectors(s, d).select("id", "vector"), _at(s, "map")),
    "track2vec_sgns": lambda s, d: skipgram.skip_gram(_orders(s, d), _at(s, "skip-gram"), passes=1),
    "track2vec_vocabulary": lambda s, d: skipgram.vocabulary(_orders(s, d)),
    "vector_lists_search": _lists,
    "vector_topk_cosine": _top,
    "vector_centroids": lambda s, d: v.centroids(_vectors(s, d), "owner").select("owner", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid")),
    "doppelganger_hybrid": _doppelganger,
    "transition_beam": lambda s, d: v.transition(s, _vectors(s, d).select("id", "vector"), 0, 7),
    "soundtrack_beam": _soundtrack,
    "name_generator": _names,
    "track2vec_w2v": lambda s, d: v.sequence_embeddings(_orders(s, d), _at(s, "track2vec")),
    "umap_substitute_clusters": _clusters,
    "quality_manifest": lambda s, d: q.manifest(_labelled(s, d), ["source", "quality", "toxic"]),
    "null_blank_guard": _guard,
    "duplicate_keys": lambda s, d: q.duplicates(t.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "key_collisions": lambda s, d: q.collisions(t.table(s, d, "part"), "p_name", "p_brand"),
    "table_audit": lambda s, d: q.audit(t.table(s, d, "part").withColumn("big", F.col("p_size") > 25), "p_type", "p_size", "big"),
    "inverted_index_search": _search,
}

_N = "sqrt(list_sum([CAST(x AS DOUBLE) * x for x in {0}]))"
_SIM = f"list_sum([CAST(a[i] AS DOUBLE) * b[i] for i in range(1, len(a) + 1)]) / ({_N.format('a')} * {_N.format('b')})"
_CENTROIDS = """dims AS (SELECT label AS owner, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings),
    means AS (SELECT owner, pos, avg(CAST(x AS DOUBLE)) AS x FROM dims GROUP BY ALL), mv AS (SELECT owner, list(x ORDER BY pos) AS m FROM means GROUP BY 1),
    cent AS (SELECT owner, [x / sqrt(list_sum([y * y for y in m])) for x in m] AS centroid FROM mv)"""


def _soundtrack_sql() -> str:
    """A stage for each role: the cheapest routes so far with every candidate, the eighty cheapest go on."""
    stages = ["r0 AS (SELECT CAST([] AS STRUCT(less DOUBLE, id BIGINT)[]) AS path, CAST([] AS VARCHAR[]) AS artists, CAST(NULL AS DOUBLE) AS last, CAST(0.0 AS DOUBLE) AS cost)"]
    for n, target in enumerate(v.CURVES["medium"], 1):
        t_ = f"CAST({target} AS DOUBLE)"
        cost = f"cost + base + CAST(0.52 AS DOUBLE) * abs(energy - {t_}) + CAST(0.16 AS DOUBLE) * abs(energy - coalesce(last, {t_})) + CAST(0.12 AS DOUBLE) * CASE WHEN list_contains(artists, artist) THEN 1.0 ELSE 0.0 END"
        stages.append(f"""r{n} AS (SELECT list_append(path, {{'less': -fit, 'id': id}}) AS path, list_append(artists, artist) AS artists, energy AS last, {cost} AS cost
            FROM r{n - 1}, c WHERE NOT list_contains([x.id for x in path], id) ORDER BY 4, 1 LIMIT 80)""")
    mood = v.VALENCE[v.prompt_context("a rainy late-night drive")]
    roles, curve = str(v.ROLES), ", ".join(f"CAST({x} AS DOUBLE)" for x in v.CURVES["medium"])
    return f"""WITH p AS (SELECT p_partkey AS id, p_brand AS artist, p_size / 50 AS energy, (p_retailprice - 900) / 100 AS valence, CAST(p_partkey % 17 AS DOUBLE) AS fit FROM part ORDER BY fit DESC, id LIMIT 10000),
        c AS (SELECT id, artist, energy, fit, CAST(0.18 AS DOUBLE) * abs(valence - CAST({mood} AS DOUBLE)) + CAST(0.14 AS DOUBLE) * (1.0 - fit / greatest((SELECT max(fit) FROM p), 1.0)) AS base FROM p),
        {", ".join(stages)}, best AS (SELECT path, artists FROM r{len(v.ROLES)} ORDER BY cost, path LIMIT 1),
        n AS (SELECT unnest(range(1, {len(v.ROLES) + 1})) AS stage, path, artists FROM best)
        SELECT stage, ({roles})[stage] AS role, path[stage].id AS id, artists[stage] AS artist, ([{curve}])[stage] AS target_energy FROM n"""


def _transition_sql() -> str:
    """From vector 0 to vector 7 in three stages: candidates near both and their midpoint, sixty routes kept at each stage."""
    dot = lambda x, y: f"list_sum([{x}[i] * {y}[i] for i in range(1, len({x}) + 1)])"
    unit = lambda x: f"[y / sqrt(list_sum([z * z for z in {x}])) for y in {x}]"
    mixed = lambda n: unit(f"[CAST({1 - n / 4} AS DOUBLE) * s[i] + CAST({n / 4} AS DOUBLE) * t[i] for i in range(1, len(s) + 1)]")
    stages = ["r0 AS (SELECT CAST([] AS BIGINT[]) AS path, CAST([] AS DOUBLE[]) AS near, s AS last, CAST(0.0 AS DOUBLE) AS cost FROM e)"]
    for n in (1, 2, 3):
        stages.append(f"""p{n} AS (SELECT {mixed(n)} AS p FROM e),
            r{n} AS (SELECT list_append(path, id) AS path, list_append(near, {dot("v", "last")}) AS near, v AS last, cost + CAST(0.7 AS DOUBLE) * (1 - {dot("v", "last")}) + CAST(0.3 AS DOUBLE) * (1 - {dot("v", "p")}) AS cost
            FROM r{n - 1}, c, p{n} WHERE NOT list_contains(path, id) ORDER BY 4, 1 LIMIT 60)""")
    return f"""WITH d AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) for x in embedding] AS w FROM embeddings), u AS (SELECT id, {unit("w")} AS v FROM d),
        e AS (SELECT x.v AS s, y.v AS t FROM u x, u y WHERE x.id = 0 AND y.id = 7),
        q AS (SELECT 0 AS k, s AS q FROM e UNION ALL SELECT 1, {unit("[s[i] + t[i] for i in range(1, len(s) + 1)]")} FROM e UNION ALL SELECT 2, t FROM e),
        g AS (SELECT k, id FROM u, q WHERE id NOT IN (0, 7) QUALIFY row_number() OVER (PARTITION BY k ORDER BY round({dot("v", "q")}, 6) DESC, id) <= 40),
        c AS (SELECT id, v FROM u WHERE id IN (SELECT id FROM g)), {", ".join(stages)},
        best AS (SELECT path, near FROM r3, e ORDER BY cost + CAST(0.8 AS DOUBLE) * (1 - {dot("last", "t")}), path LIMIT 1)
        SELECT n AS stage, path[n] AS id, round(near[n], 6) AS similarity FROM best, (SELECT unnest(range(1, 4)) AS n)"""


_TOKENS = "w AS (SELECT doc_id AS id, n_chars AS rank, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents WHERE text IS NOT NULL)"
ORACLE = {
    "search_index_tokens": f"WITH {_TOKENS} SELECT token, count(DISTINCT id) AS texts, count(*) AS times FROM w GROUP BY token",
    "search_index_words": f"""WITH {_TOKENS}, h AS (SELECT id, rank, count(DISTINCT token) AS words, count(*) AS score FROM w WHERE token IN ('the', 'and', 'of') GROUP BY ALL)
        SELECT id, score, rank FROM h WHERE words = 3 ORDER BY score DESC, rank, id LIMIT 20""",
    "search_index_prefix": f"""WITH {_TOKENS}, h AS (SELECT id, rank, count(*) FILTER (token = 'the') AS a, count(*) FILTER (starts_with(token, 'wo')) AS b FROM w GROUP BY ALL)
        SELECT id, a + b AS score, rank FROM h WHERE a > 0 AND b > 0 ORDER BY score DESC, rank, id LIMIT 20""",
    "soundtrack_beam": _soundtrack_sql(),
    "transition_beam": _transition_sql(),
    "track2vec_vocabulary": "SELECT CAST(l_partkey AS VARCHAR) AS word, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) >= 5",
    "vector_topk_cosine": f"""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.embedding AS a, q.embedding AS b FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
        s AS (SELECT query_id, id, round({_SIM}, 6) AS similarity FROM p)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 10""",
    "vector_centroids": f"WITH {_CENTROIDS} SELECT owner, [round(x, 6) for x in centroid] AS centroid FROM cent",
    "doppelganger_hybrid": f"""WITH {_CENTROIDS}, own AS (SELECT centroid AS b FROM cent WHERE owner = 3),
        o AS (SELECT vec_id AS id, label AS owner, embedding AS a, b FROM embeddings, own WHERE label <> 3), s AS (SELECT id, owner, round({_SIM}, 6) AS s FROM o ORDER BY s DESC, id LIMIT 300),
        r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY s DESC, id) AS r FROM s),
        p AS (SELECT owner, avg(s) FILTER (r <= 3) AS e, count(*) AS support FROM r GROUP BY 1),
        tg0 AS (SELECT DISTINCT CAST(p_partkey % 10 AS INT) AS owner, unnest(string_split(p_name, ' ')) AS tag FROM part),
        tg AS (SELECT owner, list(tag ORDER BY tag)[1:8] AS tags FROM tg0 GROUP BY 1), mine AS (SELECT tags AS m FROM tg WHERE owner = 3),
        j AS (SELECT p.owner, e, support, CASE WHEN len(list_distinct(coalesce(tags, []) || m)) = 0 THEN 0.0 ELSE len(list_intersect(coalesce(tags, []), m)) / len(list_distinct(coalesce(tags, []) || m)) END AS g FROM p LEFT JOIN tg ON tg.owner = p.owner, mine)
        SELECT owner, round(e * CAST(0.72 AS DOUBLE) + g * (1 - CAST(0.72 AS DOUBLE)), 4) AS similarity, round(e, 4) AS embedding_similarity, round(g, 4) AS tag_similarity, support
        FROM j ORDER BY similarity DESC, support DESC, owner LIMIT 5""",
    "quality_manifest": """WITH l AS (SELECT source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
        SELECT count(*) AS rows, count(source) AS has_source, count(quality) AS has_quality, count(toxic) AS has_toxic, round(count(source) * 100.0 / count(*), 2) AS pct_source,
               round(count(quality) * 100.0 / count(*), 2) AS pct_quality, round(count(toxic) * 100.0 / count(*), 2) AS pct_toxic FROM l""",
    "null_blank_guard": """WITH b AS (SELECT count(*) AS rows, count(*) FILTER (p_partkey % 40 = 0) AS blank FROM part), s AS (SELECT *, round(blank * 1.0 / greatest(rows, 1), 4) AS blank_share FROM b)
        SELECT *, blank_share <= 0.05 AS ok FROM s""",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "key_collisions": "SELECT p_name, count(DISTINCT p_brand) AS values, count(*) AS rows FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1",
    "table_audit": "SELECT p_type, count(*) AS rows, count(*) FILTER (p_size > 25) AS flagged, round(avg(p_size), 3) AS mean, min(p_size) AS least, max(p_size) AS most FROM part GROUP BY 1",
    "inverted_index_search": """SELECT p_partkey AS id, CAST(2 AS BIGINT) AS score, p_partkey * 7919 % 1009 AS rank FROM part WHERE p_name = 'red widget' ORDER BY rank, id LIMIT 10""",
}
