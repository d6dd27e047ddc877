"""Queries that look after the graph: neighbours, links, filters, registries, deletion, versions, checks and grants."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import lifecycle as L
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import resolve as R
from ..session import table
from .graphs import _SMALL, _places, _regions
from .model import CHUNKS, GRAPH, chunks, edges, entities, undirected
from .registry import query

_RECURSIVE = GRAPH.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    _RECURSIVE + ", r(start, node, distance) AS (SELECT id, id, 0 FROM entities WHERE id LIKE 'R:%' UNION SELECT start, src, distance + 1 FROM r JOIN edges ON dst = node AND rel_type IN ('LOCATED_IN', 'PART_OF') WHERE distance < 2) "
    "SELECT start, node, CAST(min(distance) AS INT) AS distance FROM r WHERE node <> start GROUP BY start, node"
)
def incoming_neighbors(spark, sf_dir):
    return M.neighbors(edges(spark, sf_dir), _regions(spark, sf_dir), ["LOCATED_IN", "PART_OF"], "in", 2)


@query(
    GRAPH + ", o AS (SELECT id FROM entities WHERE NOT coalesce(is_deleted, false) AND id NOT IN (SELECT a FROM both_ways)), g AS (SELECT id FROM entities WHERE coalesce(is_deleted, false)) "
    "SELECT 'orphan_entities' AS metric, count(*) AS value FROM o UNION ALL SELECT 'dangling_edges', count(*) FROM edges WHERE src IN (SELECT id FROM g) OR dst IN (SELECT id FROM g) "
    "UNION ALL SELECT 'deleted_with_edges', count(*) FROM g WHERE id IN (SELECT a FROM both_ways) UNION ALL SELECT 'self_references', count(*) FROM edges WHERE src = dst "
    "UNION ALL SELECT 'missing_descriptions', count(*) FROM entities WHERE coalesce(description, '') = ''"
)
def integrity_stats(spark, sf_dir):
    nodes, edge = entities(spark, sf_dir), edges(spark, sf_dir)
    return Q.counted({
        "orphan_entities": M.orphans(nodes, edge), "dangling_edges": M.dangling(nodes, edge), "deleted_with_edges": M.inconsistent(nodes, undirected(edge)),
        "self_references": edge.where("src = dst"), "missing_descriptions": nodes.where("coalesce(description, '') = ''"),
    })


@query(
    "SELECT concat('S:', l_suppkey) AS src, concat('P:', l_partkey) AS dst, l_linestatus AS rel_type, max(l_discount) AS confidence, arg_max(d, struct_pack(n := length(d), d := d)) AS description, "
    "string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ',' ORDER BY CAST(l_orderkey AS VARCHAR)) AS chunks FROM (SELECT *, concat('order ', l_orderkey, ' line ', l_linenumber) AS d FROM lineitem) GROUP BY l_suppkey, l_partkey, l_linestatus"
)
def merged_relations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('S:', l_suppkey) AS src", "concat('P:', l_partkey) AS dst", "l_linestatus AS rel_type", "l_discount AS confidence", "concat('order ', l_orderkey, ' line ', l_linenumber) AS description", "cast(l_orderkey AS string) AS chunk"
    )
    return M.merged_relations(rows).withColumn("chunks", F.array_join("chunks", ","))


@query(
    CHUNKS + ", c AS (SELECT doc_id, count(*) AS n, sum(length(text)) AS chars FROM chunks GROUP BY doc_id) SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks, "
    "round(coalesce(sum(n), 0) / count(*), 6) AS per_document, CAST(coalesce(sum(CAST(ceil(chars / 4.0) AS BIGINT)), 0) AS BIGINT) AS tokens FROM documents LEFT JOIN c USING (doc_id) GROUP BY lang"
)
def pipeline_summary(spark, sf_dir):
    """Documents, outputs, sizes and estimated tokens of each language."""
    docs = table(spark, sf_dir, "documents")
    made = chunks(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"))
    rows = docs.select("doc_id", "lang", "n_chars").join(made, "doc_id", "left")
    n = F.coalesce(F.sum("n"), F.lit(0))
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), n.alias("chunks"), F.round(n / F.count("*"), 6).alias("per_document"), F.coalesce(F.sum(F.ceil(F.col("size") / 4.0)), F.lit(0)).alias("tokens"))


@query(
    GRAPH + ", m AS (SELECT dst AS region, src AS id FROM edges WHERE rel_type = 'PART_OF' UNION ALL SELECT id, id FROM entities WHERE id LIKE 'R:%'), j AS (SELECT region, m.id, name, confidence FROM m JOIN entities e ON e.id = m.id) "
    "SELECT min(id) AS community, count(*) AS size, round(avg(confidence), 6) AS confidence, array_to_string(list_sort(list(name))[1:3], ', ') AS summary FROM j GROUP BY region HAVING count(*) >= 2"
)
def component_communities(spark, sf_dir):
    """Components of places with two members at least, with the first names as their summary."""
    places = entities(spark, sf_dir).where("type = 'LOCATION'")
    comps = G.components(undirected(edges(spark, sf_dir).where("rel_type = 'PART_OF'")), places.select("id"))
    rows = comps.join(places, "id").select(F.col("component").alias("community"), "name", "confidence")
    first = rows.withColumn("pick", F.row_number().over(Window.partitionBy("community").orderBy("name"))).where("pick <= 3").groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("summary"))
    return rows.groupBy("community").agg(F.count("*").alias("size"), F.round(F.avg("confidence"), 6).alias("confidence")).where("size >= 2").join(first, "community")


@query(
    _RECURSIVE + ", " + _SMALL + ", l AS (SELECT a, b FROM both_small WHERE a LIKE 'R:%' AND b LIKE 'N:%' OR a LIKE 'N:%' AND b LIKE 'R:%'), n AS (SELECT id, confidence FROM entities WHERE type = 'LOCATION'), "
    "p(start, node, path) AS (SELECT id, id, [id] FROM n UNION ALL SELECT start, b, list_append(path, b) FROM p JOIN l ON a = node WHERE len(path) <= 4 AND NOT list_contains(path, b)), "
    "i AS (SELECT unnest(path[2:-2]) AS node FROM p WHERE len(path) > 2), c AS (SELECT node, count(*) AS k FROM i GROUP BY node) "
    "SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) // 2 FROM l) AS edges, (SELECT count(DISTINCT s) FROM (SELECT start, min(node) AS s FROM p GROUP BY start)) AS components, "
    "(SELECT CAST(max(len(path)) - 1 AS INT) FROM p) AS longest, (SELECT count(*) FROM c WHERE k > (SELECT avg(k) FROM c)) AS bridges, (SELECT round(avg(confidence), 6) FROM n) AS relevance"
)
def subgraph_metrics(spark, sf_dir):
    """Of the places' subgraph: nodes, edges, components, the longest simple path (of four hops at most), bridges, mean relevance."""
    places = entities(spark, sf_dir).where("type = 'LOCATION'")
    links = edges(spark, sf_dir).where("rel_type = 'PART_OF'")
    ids, both = places.select("id"), undirected(links)
    paths = G.cut(G.simple_paths(both, ids, ids, 4))
    whole = places.agg(F.count("*").alias("nodes"), F.round(F.avg("confidence"), 6).alias("relevance"))
    parts = [
        links.agg(F.count("*").alias("edges")), G.components(both, ids).agg(F.countDistinct("component").alias("components")),
        paths.agg((F.max(F.size("path")) - 1).alias("longest")), G.bridges(paths).agg(F.count("*").alias("bridges")),
    ]
    for part in parts:
        whole = whole.crossJoin(part)
    return whole.select("nodes", "edges", "components", "longest", "bridges", "relevance")


@query(
    _RECURSIVE + ", " + _SMALL + ", t AS (SELECT a, b, min(rel_type) AS k FROM both_ways GROUP BY a, b), p(start, node, path, kinds) AS (SELECT id, id, [id], CAST([] AS VARCHAR[]) FROM entities WHERE id LIKE 'R:%' "
    "UNION ALL SELECT start, p_.b, list_append(path, p_.b), list_append(kinds, k) FROM p JOIN both_small p_ ON p_.a = node JOIN t ON t.a = p_.a AND t.b = p_.b WHERE len(path) <= 2 AND NOT list_contains(path, p_.b)) "
    "SELECT start, node AS \"end\", array_to_string(path, '>') AS path, array_to_string(kinds, ',') AS predicates FROM p WHERE node LIKE 'S:%'"
)
def path_predicates(spark, sf_dir):
    targets = entities(spark, sf_dir).where("id like 'S:%'").select("id")
    edge = edges(spark, sf_dir)
    paths = G.simple_paths(undirected(edge), _regions(spark, sf_dir), targets, 2)
    return M.path_predicates(paths, edge).withColumn("path", F.array_join("path", ">"))


@query(
    _RECURSIVE + ", " + _SMALL + ", p(start, node, path) AS (SELECT id, id, [id] FROM entities WHERE id IN ('R:0', 'R:1', 'R:2') UNION ALL SELECT start, b, list_append(path, b) FROM p JOIN both_small ON a = node WHERE len(path) <= 4 AND NOT list_contains(path, b)) "
    "SELECT array_to_string(path, '>') AS chain, round(0.8 - 0.1 * (len(path) - 2), 6) AS confidence FROM p WHERE len(path) > 1"
)
def relationship_chains(spark, sf_dir):
    """Breadth-first paths of up to five places from three topics; the longer, the less sure."""
    topics = entities(spark, sf_dir).where("id in ('R:0', 'R:1', 'R:2')").select("id")
    every = entities(spark, sf_dir).select("id")
    found = G.shortest_paths(_places(spark, sf_dir), topics, every, 4)
    return found.select(F.array_join("path", ">").alias("chain"), F.round(0.8 - 0.1 * (F.col("length") - 1), 6).alias("confidence"))


@query(
    GRAPH + ", s AS (SELECT id FROM entities WHERE id LIKE 'N:%'), f AS (SELECT a, b, bool_or(contains(lower(rel_type), 'located')) AS dep FROM both_ways WHERE a IN (SELECT id FROM s) GROUP BY a, b), l AS (SELECT DISTINCT a, b FROM both_ways), "
    "far AS (SELECT f.a, count(DISTINCT l.b) AS n FROM f JOIN l ON l.a = f.b WHERE l.b <> f.a AND NOT EXISTS (SELECT 1 FROM f g WHERE g.a = f.a AND g.b = l.b) GROUP BY f.a) "
    "SELECT f.a AS id, count(*) AS direct, coalesce(max(n), 0) AS indirect, count_if(dep) AS dependents FROM f LEFT JOIN far ON far.a = f.a GROUP BY f.a"
)
def impacts(spark, sf_dir):
    return M.impact(undirected(edges(spark, sf_dir)), entities(spark, sf_dir).where("id like 'N:%'").select("id"), ["located"])


# Links, filters and registries.


@query("SELECT DISTINCT concat('O:', l_orderkey) AS chunk, concat('P:', l_partkey) AS entity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def mention_links(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P:"), "l_partkey").alias("id"), F.array(F.concat(F.lit("O:"), "l_orderkey")).alias("chunk_ids"))
    parts = table(spark, sf_dir, "part").where("p_size > 5").select(F.concat(F.lit("P:"), "p_partkey").alias("id"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("O:"), "o_orderkey").alias("id"))
    return M.mention_links(rows, parts, orders)


@query("SELECT label AS community, vec_id AS member, n AS member_count, round(1.0 / n, 6) AS weight FROM embeddings JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)")
def community_load(spark, sf_dir):
    """Members of each community, with its size and their weight."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("community"), F.col("vec_id").alias("member"))
    sizes = rows.groupBy("community").agg(F.count("*").alias("member_count"))
    return rows.join(sizes, "community").select("community", "member", "member_count", F.round(1.0 / F.col("member_count"), 6).alias("weight"))


@query(GRAPH + "SELECT id FROM entities WHERE confidence >= 0.6 AND type IN ('ORGANIZATION', 'PRODUCT') AND trim(coalesce(name, '')) <> ''")
def accepted_entities(spark, sf_dir):
    return M.accepted_entities(entities(spark, sf_dir), 0.6, ["ORGANIZATION", "PRODUCT"]).select("id")


_EXTRACTED = (
    "SELECT upper(s_name) AS source, CASE WHEN s_suppkey % 5 = 0 THEN 'NOWHERE' ELSE concat(' ', n_name) END AS target, CASE WHEN s_suppkey % 7 = 0 THEN 'KNOWS' ELSE 'LOCATED_IN' END AS predicate, CAST((s_suppkey * 17) % 100 AS DOUBLE) / 100 AS confidence "
    "FROM supplier JOIN nation ON n_nationkey = s_nationkey"
)


@query(
    GRAPH + f", x AS ({_EXTRACTED}), k AS (SELECT lower(trim(name)) AS norm, min(id) AS id FROM (SELECT name, id FROM entities UNION ALL SELECT concat('alias of ', name), id FROM entities) GROUP BY 1) "
    "SELECT a.id AS source_id, b.id AS target_id, predicate, confidence FROM x JOIN k a ON a.norm = lower(trim(source)) JOIN k b ON b.norm = lower(trim(target)) WHERE confidence >= 0.3 AND predicate = 'LOCATED_IN'"
)
def accepted_relations(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).selectExpr(
        "upper(s_name) AS source", "CASE WHEN s_suppkey % 5 = 0 THEN 'NOWHERE' ELSE concat(' ', n_name) END AS target", "CASE WHEN s_suppkey % 7 = 0 THEN 'KNOWS' ELSE 'LOCATED_IN' END AS predicate", "CAST((s_suppkey * 17) % 100 AS DOUBLE) / 100 AS confidence"
    )
    names = entities(spark, sf_dir).select("name", "id")
    return M.accepted_relations(rows, names.unionByName(names.select(F.concat(F.lit("alias of "), "name").alias("name"), "id")), 0.3, ["LOCATED_IN"])


_REGISTRY = "WITH g AS (SELECT p_partkey AS id, p_name AS name FROM part), a AS (SELECT p_partkey AS id, p_brand AS alias FROM part), m AS (SELECT p_partkey AS source, p_partkey // 10 * 10 + 1 AS target FROM part WHERE p_partkey % 10 > 6) "


@query(
    _REGISTRY + ", n AS (SELECT coalesce(target, id) AS id, alias FROM a LEFT JOIN m ON source = id UNION ALL SELECT target, name FROM g JOIN m ON source = id) "
    "SELECT id, min(alias) AS alias FROM n GROUP BY id, lower(trim(alias))"
)
def merged_aliases(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    registry, aliases = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("alias"))
    merges = part.where("p_partkey % 10 > 6").select(F.col("p_partkey").alias("source"), (F.floor(F.col("p_partkey") / 10) * 10 + 1).alias("target"))
    return R.merge_entities(registry, aliases, merges)[1]


@query(
    _REGISTRY + "SELECT id, name, (SELECT count(*) FROM a WHERE a.id = g.id) AS n_aliases FROM g WHERE contains(lower(name), 'red') OR id IN (SELECT id FROM a WHERE contains(lower(alias), 'red'))"
)
def registry_search(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return R.registry_search(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("alias")), "RED")


@query(
    "WITH c AS (SELECT p_partkey AS id, lower(trim(p_name)) AS n, lower(p_type) AS d FROM part), s AS (SELECT id, CASE WHEN contains(n, 'red bolt') OR contains('red bolt', n) THEN 0.95 WHEN 2 * (CAST(contains(n, 'red') AS INT) + CAST(contains(n, 'bolt') AS INT)) >= 2 THEN 0.8 "
    "WHEN 1 - levenshtein(n, 'red bolt') / CAST(greatest(length(n), 8) AS DOUBLE) >= 0.5 THEN 1 - levenshtein(n, 'red bolt') / CAST(greatest(length(n), 8) AS DOUBLE) WHEN contains(d, 'red bolt') THEN 0.7 END AS score FROM c WHERE n <> '') "
    "SELECT id, round(CAST(score AS DOUBLE), 6) AS score FROM s WHERE score IS NOT NULL"
)
def best_matches(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return R.matches(rows, "Red bolt", 0.5).select("id", F.round("score", 6).alias("score"))


@query("SELECT doc_id AS id, CAST(0.5 AS DOUBLE) AS score FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id LIMIT 10")
def text_fallback(spark, sf_dir):
    """The search without an index: the first texts that hold a word, all with one score."""
    return table(spark, sf_dir, "documents").where(M.contains_ci("text", "The")).select(F.col("doc_id").alias("id"), F.lit(0.5).alias("score")).orderBy("id").limit(10)


# Lifecycle.


@query(
    _RECURSIVE + ", " + _SMALL + ", r(node, d) AS (SELECT 'R:1', 0 UNION SELECT b, d + 1 FROM r JOIN both_small ON a = node WHERE d < 2) "
    "SELECT 'nodes' AS kind, count(*) AS deleted FROM entities WHERE coalesce(is_deleted, false) OR id IN (SELECT node FROM r) UNION ALL SELECT 'edges', count(*) FROM edges WHERE rel_type <> 'PRODUCES' AND (src IN (SELECT node FROM r WHERE node NOT IN (SELECT id FROM entities WHERE is_deleted)) OR dst IN (SELECT node FROM r WHERE node NOT IN (SELECT id FROM entities WHERE is_deleted)))"
)
def cascade_by_depth(spark, sf_dir):
    nodes, edge = entities(spark, sf_dir), edges(spark, sf_dir).where("rel_type <> 'PRODUCES'")
    n, e = L.cascade(nodes, edge, nodes.where("id = 'R:1'").select("id"), 2)
    part = lambda d, kind: d.where("is_deleted").agg(F.count("*").alias("deleted")).select(F.lit(kind).alias("kind"), "deleted")
    return part(n, "nodes").unionByName(part(e, "edges"))


@query(GRAPH + "SELECT id, (SELECT count(*) FROM both_ways WHERE a = id) AS n_edges FROM entities WHERE coalesce(is_deleted, false)")
def deleted_nodes(spark, sf_dir):
    return L.deleted(entities(spark, sf_dir), edges(spark, sf_dir))


@query(GRAPH + "SELECT id, CASE WHEN type = 'PRODUCT' THEN DATE '2024-06-01' ELSE created_on END AS updated_at, CAST(version + CASE WHEN type = 'PRODUCT' THEN 1 ELSE 0 END AS INT) AS version FROM entities")
def touched(spark, sf_dir):
    nodes = entities(spark, sf_dir).withColumn("updated_at", F.col("created_on"))
    return L.touch(nodes, nodes.where("type = 'PRODUCT'").select("id"), datetime.date(2024, 6, 1)).select("id", "updated_at", "version")


_VERSION = "CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN 'v1' ELSE 'v2' END"


@query(f"WITH v AS (SELECT vec_id AS id, {_VERSION} AS version FROM embeddings) SELECT id, CASE WHEN (version IS NULL OR version <> 'v2') AND id % 2 = 0 THEN 'v2' ELSE version END AS version, version IS NULL OR version <> 'v2' AS was_outdated FROM v")
def migrated_vectors(spark, sf_dir):
    """Half of the outdated vectors are embedded anew."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding", f"{_VERSION} AS version")
    old = L.outdated(rows, "v2").select("id", "embedding")
    done = L.migrated(rows, old.where("id % 2 = 0"), "v2").select("id", "version")
    return done.join(old.select("id", F.lit(True).alias("o")), "id", "left").select("id", "version", F.coalesce("o", F.lit(False)).alias("was_outdated"))


# Checks and grants.


@query(
    "SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'empty' WHEN length(text) > 5000 THEN 'too_large' END AS fault, "
    "CAST(CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 0 ELSE greatest(1, length(text) // 1000) END AS BIGINT) AS chunks, CAST(CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 0 ELSE greatest(1, length(text) // 1000) END * 5 AS BIGINT) AS entities FROM documents"
)
def document_checks(spark, sf_dir):
    return Q.document_checks(table(spark, sf_dir, "documents"), most=5000)


@query(
    "WITH RECURSIVE h AS (SELECT p_partkey AS role, p_partkey // 4 AS parent FROM part), g AS (SELECT p_partkey AS role, p_brand AS permission, CASE WHEN p_size % 9 = 0 THEN 'deny' ELSE 'allow' END AS effect FROM part), "
    "u(role, owner) AS (SELECT role, role FROM h UNION SELECT u.role, h.parent FROM u JOIN h ON h.role = u.owner) SELECT u.role, permission, max(effect) AS effect FROM u JOIN g ON g.role = u.owner GROUP BY u.role, permission"
)
def role_grants(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    parents = part.select(F.col("p_partkey").alias("role"), F.floor(F.col("p_partkey") / 4).alias("parent"))
    grants = part.select(F.col("p_partkey").alias("role"), F.col("p_brand").alias("permission"), F.when(F.col("p_size") % 9 == 0, "deny").otherwise("allow").alias("effect"))
    return Q.role_grants(parents, grants)
