"""Queries by iteration: reach, paths, components; search; lifecycle; resolution."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import lifecycle as L
from ..operators import resolve as R
from ..operators import search as S
from ..session import table
from .model import GRAPH, edges, entities, undirected
from .registry import query

_SMALL = "both_small AS (SELECT DISTINCT a, b FROM both_ways WHERE rel_type <> 'PRODUCES') "


def _places(spark, sf_dir):
    """The graph of places alone, as the SQL of reach_within and connected_components has it; whole_graph_* take all edges."""
    return undirected(edges(spark, sf_dir).where("rel_type <> 'PRODUCES'"))


def _regions(spark, sf_dir):
    return entities(spark, sf_dir).where("id like 'R:%'").select("id")


@query(
    GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _SMALL + ", r(start, node, distance) AS (SELECT id, id, 0 FROM entities WHERE id LIKE 'R:%' UNION SELECT start, b, distance + 1 FROM r JOIN both_small ON a = node WHERE distance < 3) "
    "SELECT start, node, CAST(min(distance) AS INT) AS distance FROM r GROUP BY start, node"
)
def reach_within(spark, sf_dir):
    return G.reach(_places(spark, sf_dir), _regions(spark, sf_dir), 3)


@query(
    GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _SMALL + ", p(start, node, path) AS (SELECT id, id, [id] FROM entities WHERE id LIKE 'R:%' UNION ALL SELECT start, b, list_append(path, b) FROM p JOIN both_small ON a = node "
    "WHERE len(path) <= 3 AND NOT list_contains(path, b)) "
    "SELECT start, node AS \"end\", CAST(min(len(path)) - 1 AS INT) AS length FROM p WHERE node LIKE 'S:%' GROUP BY start, node"
)
def shortest_path_lengths(spark, sf_dir):
    targets = entities(spark, sf_dir).where("id like 'S:%'").select("id")
    return G.shortest_paths(undirected(edges(spark, sf_dir)), _regions(spark, sf_dir), targets, 3).select("start", "end", "length")


@query(
    GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _SMALL + ", p(start, node, path) AS (SELECT id, id, [id] FROM entities WHERE id LIKE 'R:%' UNION ALL SELECT start, b, list_append(path, b) FROM p JOIN both_small ON a = node "
    "WHERE len(path) <= 2 AND NOT list_contains(path, b)) "
    "SELECT start, node AS \"end\", array_to_string(path, '>') AS path FROM p WHERE node LIKE 'S:%'"
)
def simple_paths_to_suppliers(spark, sf_dir):
    targets = entities(spark, sf_dir).where("id like 'S:%'").select("id")
    return G.simple_paths(undirected(edges(spark, sf_dir)), _regions(spark, sf_dir), targets, 2).select("start", "end", F.array_join("path", ">").alias("path"))


@query(
    GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _SMALL + ", p(start, node, path) AS (SELECT id, id, [id] FROM entities WHERE id LIKE 'R:%' UNION ALL SELECT start, b, list_append(path, b) FROM p JOIN both_small ON a = node "
    "WHERE len(path) <= 2 AND NOT list_contains(path, b)), i AS (SELECT unnest(path[2:-2]) AS node FROM p WHERE node LIKE 'S:%'), c AS (SELECT node, count(*) AS n FROM i GROUP BY node) "
    "SELECT node, n FROM c WHERE n > (SELECT avg(n) FROM c)"
)
def bridge_nodes(spark, sf_dir):
    targets = entities(spark, sf_dir).where("id like 'S:%'").select("id")
    return G.bridges(G.simple_paths(undirected(edges(spark, sf_dir)), _regions(spark, sf_dir), targets, 2))


@query(
    GRAPH + ", root AS (SELECT src AS id, dst FROM edges WHERE rel_type = 'PART_OF'), place AS (SELECT src AS id, e.dst AS nation, root.dst FROM edges e JOIN root ON root.id = e.dst WHERE rel_type = 'LOCATED_IN'), "
    "m AS (SELECT id, dst AS region FROM place UNION ALL SELECT id, dst FROM root UNION ALL SELECT id, id FROM entities WHERE id LIKE 'R:%'), "
    "c AS (SELECT region, min(id) AS component FROM m GROUP BY region) SELECT id, component FROM m JOIN c USING (region) UNION ALL SELECT id, id FROM entities WHERE id LIKE 'P:%'"
)
def connected_components(spark, sf_dir):
    return G.components(_places(spark, sf_dir), entities(spark, sf_dir).select("id"))


# Over all edges, products too; without SQL, as recursion over them is slow. Tests compare with a search in memory.


@query()
def whole_graph_components(spark, sf_dir):
    return G.components(undirected(edges(spark, sf_dir)), entities(spark, sf_dir).select("id"))


@query()
def whole_graph_reach(spark, sf_dir):
    return G.reach(undirected(edges(spark, sf_dir)), _regions(spark, sf_dir), 3)


@query(
    "WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS parent FROM part), r AS (SELECT id, parent AS ancestor, 1 AS distance FROM p WHERE parent IS NOT NULL "
    "UNION ALL SELECT r.id, p.parent, distance + 1 FROM r JOIN p ON p.id = r.ancestor WHERE p.parent IS NOT NULL) SELECT id, ancestor, CAST(min(distance) AS INT) AS distance FROM r GROUP BY id, ancestor"
)
def hierarchy_closure(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 3)).alias("parent"))
    return G.ancestors(part)


# Search.


@query(
    "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v "
    "WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pick FROM s) "
    "SELECT query_id, id, round(score, 6) AS score, CAST(pick AS INT) AS pick FROM r WHERE pick <= 10"
)
def vector_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return S.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10).select("query_id", "id", F.round("score", 6).alias("score"), "pick")


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"


@query(
    f"WITH d AS (SELECT doc_id AS id, {_WORDS} AS ws FROM documents), q AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS})) AS w FROM benchmark), "
    "n AS (SELECT count(*) AS n, avg(len(ws)) AS al FROM d), t AS (SELECT id, len(ws) AS l, unnest(ws) AS w FROM d), tf AS (SELECT id, l, w, count(*) AS tf FROM t WHERE w IN (SELECT w FROM q) GROUP BY ALL), "
    "df AS (SELECT w, count(*) AS df FROM tf GROUP BY w), s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score "
    "FROM tf JOIN df USING (w) JOIN q USING (w), n GROUP BY query_id, id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pick FROM s) "
    "SELECT query_id, id, round(score, 4) AS score FROM r WHERE pick <= 10"
)
def text_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return S.bm25(docs, asked, 10).select("query_id", "id", F.round("score", 4).alias("score"))


# Lifecycle.


def _stored(spark, sf_dir):
    old = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    return old.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int")).alias("created_at"), F.lit(None).cast("date").alias("updated_at"), F.lit(1).alias("version"))


@query(
    "WITH s AS (SELECT c_custkey AS id, c_name AS name, CAST(DATE '2024-01-01' + CAST(c_custkey % 30 AS INT) AS DATE) AS created_at, 1 AS version FROM customer WHERE c_custkey % 3 <> 0), "
    "n AS (SELECT c_custkey AS id, upper(c_name) AS name FROM customer WHERE c_custkey % 2 = 0) "
    "SELECT coalesce(s.id, n.id) AS id, coalesce(n.name, s.name) AS name, coalesce(created_at, DATE '2024-06-01') AS created_at, CASE WHEN n.id IS NOT NULL THEN DATE '2024-06-01' END AS updated_at, "
    "CAST(coalesce(version, 0) + CASE WHEN n.id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS version FROM s FULL JOIN n ON s.id = n.id"
)
def upserted(spark, sf_dir):
    new = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"))
    return L.upsert(_stored(spark, sf_dir), new, ["id"], datetime.date(2024, 6, 1))


_DELETE = GRAPH + ", want AS (SELECT id FROM entities WHERE id LIKE 'S:%1' OR id = 'N:3' UNION ALL SELECT 'X:0'), linked AS (SELECT DISTINCT a FROM both_ways) "


@query(
    _DELETE + "SELECT w.id, CASE WHEN n.id IS NULL THEN 'not_found' WHEN coalesce(is_deleted, false) THEN 'already_deleted' WHEN w.id IN (SELECT a FROM linked) THEN 'restricted' ELSE 'deleted' END AS outcome "
    "FROM want w LEFT JOIN entities n ON n.id = w.id"
)
def delete_restricted(spark, sf_dir):
    nodes, edge = entities(spark, sf_dir), edges(spark, sf_dir)
    want = nodes.where("id like 'S:%1' or id = 'N:3'").select("id").union(spark.createDataFrame([("X:0",)], "id string"))
    return L.soft_delete(nodes, edge, want, "RESTRICT")[2]


@query(
    GRAPH + ", hit AS (SELECT id FROM entities WHERE id = 'S:1' AND NOT coalesce(is_deleted, false)), more AS (SELECT id FROM hit UNION SELECT b FROM both_ways WHERE a IN (SELECT id FROM hit)) "
    "SELECT id, coalesce(is_deleted, false) OR id IN (SELECT id FROM more) AS gone FROM entities"
)
def delete_cascade(spark, sf_dir):
    nodes, edge = entities(spark, sf_dir), edges(spark, sf_dir)
    out = L.soft_delete(nodes, edge, nodes.where("id = 'S:1'").select("id"), "CASCADE")[0]
    return out.select("id", F.coalesce("is_deleted", F.lit(False)).alias("gone"))


@query(
    "WITH q AS (SELECT event_id AS id, CASE WHEN event_type IN ('error', 'click') THEN 'pending' ELSE 'resolved' END AS status, CAST(user_id % 4 AS INT) AS c, ts FROM events), "
    "d AS (SELECT *, status = 'pending' AND ts <= TIMESTAMP '2024-01-20' AS due FROM q) "
    "SELECT id, CASE WHEN due AND c + 1 >= 3 THEN 'abandoned' ELSE status END AS status, CASE WHEN due THEN c + 1 ELSE c END AS retry_count, "
    "CASE WHEN due AND c + 1 < 3 THEN TIMESTAMP '2024-01-20' + to_minutes(CAST(5 * pow(2, c + 1) AS INT)) ELSE ts END AS next_retry FROM d"
)
def retried_queue(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type").isin("error", "click"), "pending").otherwise("resolved")
    items = rows.select(F.col("event_id").alias("id"), status.alias("status"), (F.col("user_id") % 4).cast("int").alias("retry_count"), F.lit(3).alias("max_retries"), F.col("ts").cast("timestamp").alias("next_retry"))
    out = L.retry_queue(items, datetime.datetime(2024, 1, 20, tzinfo=datetime.UTC))
    return out.select("id", "status", "retry_count", F.col("next_retry").cast("timestamp_ntz").alias("next_retry"))


# Resolution.


@query(
    "WITH m AS (SELECT DISTINCT p_name AS mention FROM part UNION SELECT DISTINCT concat(' The ', upper(p_brand)) FROM part UNION SELECT s_name FROM supplier), "
    "n AS (SELECT mention, regexp_replace(regexp_replace(trim(lower(mention)), '\\s+', ' ', 'g'), '^(the|a|an) ', '') AS norm FROM m), "
    "r AS (SELECT lower(p_name) AS norm, min(concat('P:', p_partkey)) AS id FROM part GROUP BY 1), a AS (SELECT lower(p_brand) AS norm, min(concat('P:', p_partkey)) AS id FROM part GROUP BY 1) "
    "SELECT mention, coalesce(r.id, a.id, substr(sha256(concat('canonical:', norm)), 1, 16)) AS id, CASE WHEN r.id IS NOT NULL THEN 'name' WHEN a.id IS NOT NULL THEN 'alias' ELSE 'created' END AS stage "
    "FROM n LEFT JOIN r USING (norm) LEFT JOIN a USING (norm)"
)
def canonical_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mentions = part.select(F.col("p_name").alias("mention")).union(part.select(F.concat(F.lit(" The "), F.upper("p_brand")))).union(table(spark, sf_dir, "supplier").select("s_name")).distinct()
    key = F.concat(F.lit("P:"), "p_partkey").alias("id")
    return R.lookup(mentions, part.select(key, F.col("p_name").alias("name")), part.select(key, F.col("p_brand").alias("alias")))


#: The least label of a component is known after as many rounds as the widest component has links between two names, at most.
_ROUNDS = 12
_RESOLVED = (
    GRAPH + ", m AS MATERIALIZED (SELECT id, type, regexp_replace(regexp_replace(trim(lower(name)), '\\s+', ' ', 'g'), '^(the|a|an) ', '') AS norm FROM entities), "
    "u AS MATERIALIZED (SELECT type, norm, min(id) AS rep FROM m GROUP BY ALL), "
    "k AS MATERIALIZED (SELECT x.rep AS a, y.rep AS b FROM u x JOIN u y ON x.type = y.type AND x.norm <> y.norm AND abs(length(x.norm) - length(y.norm)) <= 0.15 * greatest(length(x.norm), length(y.norm)) + 1e-9 "
    "WHERE levenshtein(x.norm, y.norm) <= floor(0.15 * greatest(length(x.norm), length(y.norm)) + 1e-9)), l0 AS MATERIALIZED (SELECT rep, rep AS c FROM u)"
    + "".join(f", l{i} AS MATERIALIZED (SELECT o.rep, least(o.c, coalesce(n.c, o.c)) AS c FROM l{i - 1} o LEFT JOIN (SELECT a, min(c) AS c FROM k JOIN l{i - 1} ON rep = b GROUP BY a) n ON n.a = o.rep)" for i in range(1, _ROUNDS + 1))
    + f" SELECT m.id, c AS cluster FROM m JOIN u ON m.type = u.type AND m.norm = u.norm JOIN l{_ROUNDS} l ON l.rep = u.rep"
)


@query(_RESOLVED)
def resolved_entities(spark, sf_dir):
    return R.resolve(entities(spark, sf_dir).select("id", "type", "name"))


@query(
    "SELECT p_partkey AS id, substr(sha256(concat('PRODUCT:', lower(trim(p_name)))), 1, 16) AS entity, regexp_replace(replace(replace(upper(p_name), ' ', '_'), '-', '_'), '_+', '_', 'g') AS predicate, "
    "substr(md5(concat('local:', p_name, ':', p_size, ':v1')), 1, 12) AS version FROM part"
)
def stable_ids(spark, sf_dir):
    version = T.embedding_version(F.lit("local"), F.col("p_name"), F.col("p_size"), F.lit("v1"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.entity_id(F.lit("PRODUCT"), "p_name").alias("entity"), T.normalize_predicate("p_name").alias("predicate"), version.alias("version"))


@query(
    "WITH n AS (SELECT DISTINCT p_name AS x FROM part), p AS (SELECT a.x AS a, b.x AS b FROM n a JOIN n b ON substr(a.x, 1, 1) = substr(b.x, 1, 1) AND a.x < b.x), "
    "g AS (SELECT a, b, list_distinct(list_transform(range(1, len(a)), lambda i: substr(a, i, 2))) AS x, list_distinct(list_transform(range(1, len(b)), lambda i: substr(b, i, 2))) AS y FROM p) "
    "SELECT a, b, round(1 - levenshtein(a, b) / CAST(greatest(len(a), len(b)) AS DOUBLE), 6) AS edit, round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 6) AS ngram FROM g"
)
def name_similarity(spark, sf_dir):
    """Similarity of names that share their first letter: some dozens of distinct names."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    pairs = names.withColumn("k", F.substring("a", 1, 1)).join(names.select(F.col("a").alias("b"), F.substring("a", 1, 1).alias("k")), "k").where("a < b")
    return pairs.select("a", "b", F.round(T.edit_similarity("a", "b"), 6).alias("edit"), F.round(T.ngram_similarity("a", "b"), 6).alias("ngram"))


@query(
    "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) = 0 THEN 'unknown' ELSE 'en' END AS language, octet_length(encode(text)) AS n_bytes, length(trim(text)) AS stripped, "
    "round(CASE WHEN length(text) = 0 THEN 0.0 ELSE (length(text) - length(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(9), ''))) / CAST(length(text) AS DOUBLE) END, 6) AS white, "
    "concat('[ANON:', substr(sha256(text), 1, 12), ']') AS masked FROM documents"
)
def text_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", T.language("text").alias("language"), F.octet_length("text").cast("long").alias("n_bytes"), F.length(F.trim("text")).cast("long").alias("stripped"),
        F.round(T.white_ratio("text"), 6).alias("white"), T.mask("text").alias("masked"),
    )
