"""Queries of paths between topics and of evidence from all producers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paths as P
from ..operators.graph import cut
from ..session import table
from .model import CHUNKS, EDGES, ENTITIES, chunks, edges, entities
from .registry import query

#: All simple paths of at most five hops between nations, by the pairs' order; a node is followed only if a nation can still be reached.
_TOPICS = (
    f"WITH RECURSIVE {ENTITIES}, {EDGES}, ways AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), "
    "p(start, node, path) AS (SELECT id, id, [id] FROM entities WHERE id LIKE 'N:%' UNION ALL SELECT start, b, list_append(path, b) FROM p JOIN ways ON a = node "
    "WHERE len(path) <= 5 AND NOT list_contains(path, b) AND CASE WHEN b LIKE 'N:%' THEN 0 WHEN b LIKE 'P:%' THEN 2 ELSE 1 END <= 5 - len(path)), "
    "ranked AS (SELECT start, node AS \"end\", path, CAST(row_number() OVER (PARTITION BY start, node ORDER BY len(path), path) AS INT) AS pick FROM p WHERE node LIKE 'N:%' AND start < node), "
    "topic AS MATERIALIZED (SELECT * FROM ranked WHERE pick <= 3), "
    "steps AS (SELECT start, \"end\", pick, len(path) AS size, unnest(range(len(path))) AS i, unnest(path) AS node, unnest(list_append(path[2:], NULL)) AS next FROM topic), "
    "kinds AS (SELECT a, b, min(rel_type) AS predicate FROM (SELECT src AS a, dst AS b, rel_type FROM edges UNION ALL SELECT dst, src, rel_type FROM edges) GROUP BY a, b), "
    "told AS MATERIALIZED (SELECT start, \"end\", pick, CAST(any_value(size) - 1 AS INT) AS length, string_agg(name || CASE WHEN next IS NULL THEN '' ELSE ' →[' || predicate || ']→ ' END, '' ORDER BY i) AS content, "
    "sum(confidence) / any_value(size) AS mean FROM steps JOIN entities ON id = node LEFT JOIN kinds ON a = node AND b = next GROUP BY start, \"end\", pick) "
)
_PATH_SCORE = "least(1.0, greatest(0.0, mean * greatest(0.5, 1.0 - (length - 1) * 0.1)))"


def _nodes(spark, sf_dir):
    """All entities with their relevance and their distance from the regions."""
    far = F.when(F.col("id").startswith("R:"), 0).when(F.col("id").startswith("N:"), 1).when(F.col("id").startswith("P:"), 3).otherwise(2)
    return entities(spark, sf_dir).select("id", "name", "description", F.col("confidence").alias("relevance"), far.alias("distance"))


def _links(spark, sf_dir):
    return cut(edges(spark, sf_dir).select("src", "dst", F.col("rel_type").alias("predicate")))


def _topic_paths(spark, sf_dir, links):
    nations = entities(spark, sf_dir).where("id like 'N:%'").select("id")
    pairs = nations.select(F.col("id").alias("start")).join(nations.select(F.col("id").alias("end")), F.col("start") < F.col("end"))
    both = links.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(links.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    return P.best_paths(both, pairs, 3, 5)


@query(_TOPICS + f"SELECT start, \"end\", t.pick, array_to_string(path, '>') AS path, content, round({_PATH_SCORE}, 6) AS score FROM topic t JOIN told USING (start, \"end\", pick)")
def topic_paths(spark, sf_dir):
    """The three best paths of each pair of nations over the whole graph, and what they tell."""
    links = _links(spark, sf_dir)
    paths = _topic_paths(spark, sf_dir, links)
    told = P.path_evidence(paths, _nodes(spark, sf_dir), links)
    keyed = paths.withColumn("key", F.concat_ws("|", "start", "end", "pick")).join(told, "key")
    return keyed.select("start", "end", "pick", F.array_join("path", ">").alias("path"), F.expr("substring(content, 18)").alias("content"), F.round("score", 6).alias("score"))


_DISTANCE = "CASE WHEN {0} LIKE 'R:%' THEN 0 WHEN {0} LIKE 'N:%' THEN 1 WHEN {0} LIKE 'P:%' THEN 3 ELSE 2 END"


@query(
    _TOPICS + ", " + CHUNKS.removeprefix("WITH ") + ", rows_ AS ("
    f"SELECT 1 AS producer, concat_ws('|', src, dst, rel_type) AS key, concat_ws(' ', x.name, rel_type, y.name) AS content, NULL AS named, 'DIRECT' AS kind, least(x.confidence, y.confidence) AS score, least({_DISTANCE.format('src')}, {_DISTANCE.format('dst')}) AS hop, 1 AS length "
    "FROM edges JOIN entities x ON x.id = src JOIN entities y ON y.id = dst "
    f"UNION ALL SELECT 2, id, name || ': ' || description, NULL, 'DIRECT', confidence, {_DISTANCE.format('id')}, 0 FROM entities WHERE description <> '' "
    "UNION ALL SELECT 3, concat(doc_id, '-', pos), substr(text, 1, 500), NULL, 'CONTEXTUAL', 1.0 / (pos + 1), 0, 0 FROM chunks WHERE contains(lower(text), 'license') "
    "UNION ALL SELECT 4, concat('C:', c_custkey), c_name || ': ' || c_mktsegment, NULL, 'DIRECT', c_acctbal / 10000, 0, 0 FROM customer WHERE c_acctbal > 9000 "
    "UNION ALL SELECT 5, concat('N:', n_nationkey), '[Community Context] ' || n_name || ': ' || count(*) || ' members', n_name || ': ' || count(*) || ' members', 'COMMUNITY', 0.5, 1, 0 FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name "
    "UNION ALL SELECT 6, concat('S:', s_suppkey), '[Query Result] name: ' || s_name || CASE WHEN s_suppkey = 0 THEN '' ELSE '; number: ' || s_suppkey END, NULL, 'DIRECT', 0.7, 0, 0 FROM supplier WHERE s_acctbal < 0 "
    f"UNION ALL SELECT 7, concat_ws('|', start, \"end\", pick), '[Reasoning Path] ' || content, concat_ws('_', 'path', start, \"end\", pick - 1, content), 'PATH', {_PATH_SCORE}, 0, length FROM told), "
    "ids AS (SELECT concat('ev_', substr(sha256(coalesce(named, content)), 1, 12)) AS id, * FROM rows_), "
    "first_ AS (SELECT * FROM ids QUALIFY row_number() OVER (PARTITION BY id ORDER BY producer, key, content) = 1) "
    "SELECT id, CAST(producer AS INT) AS producer, content, kind, round(least(1.0, greatest(0.0, score)), 6) AS score, CAST(hop AS INT) AS hop, CAST(length AS INT) AS length FROM first_"
)
def extracted_evidence(spark, sf_dir):
    """Evidence of the whole graph from seven producers, the first one of an id winning."""
    nodes, links = cut(_nodes(spark, sf_dir)), _links(spark, sf_dir)
    found = chunks(table(spark, sf_dir, "documents")).where(F.contains(F.lower("text"), F.lit("license")))
    customers = table(spark, sf_dir, "customer")
    groups = customers.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")).join(table(spark, sf_dir, "nation"), "n_nationkey")
    poor = table(spark, sf_dir, "supplier").where("s_acctbal < 0")
    producers = [
        P.edge_evidence(links, nodes),
        P.description_evidence(nodes),
        P.chunk_evidence(found.select(F.concat_ws("-", "doc_id", "pos").alias("id"), "text", (1.0 / (F.col("pos") + 1)).alias("score"))),
        P.entity_evidence(customers.where("c_acctbal > 9000").select(F.concat(F.lit("C:"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), (F.col("c_acctbal") / 10000).alias("score"))),
        P.community_evidence(groups.select(F.concat(F.lit("N:"), "n_nationkey").alias("id"), F.concat("n_name", F.lit(": "), "n", F.lit(" members")).alias("summary"), F.lit(None).cast("double").alias("score"))),
        P.row_evidence(poor.select(F.concat(F.lit("S:"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("number"), F.lit(None).cast("double").alias("score")), ["name", "number"]),
        P.path_evidence(_topic_paths(spark, sf_dir, links), nodes, links),
    ]
    return P.first_of_producers(producers).select("id", "producer", "content", "kind", F.round("score", 6).alias("score"), "hop", "length")
