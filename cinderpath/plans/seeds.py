"""Queries of seed subgraphs: each supplier asks about its products, in the seven ways of asking by turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import seeds as S
from ..operators.graph import cut
from .model import EDGES, edges
from .registry import query

_KINDS = [*S.HOPS, "open"]


def _subgraphs(spark, sf_dir):
    links = cut(edges(spark, sf_dir))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.substring("src", 3, 20).cast("int") % len(_KINDS)) + 1)
    topics = links.where("rel_type = 'PRODUCES'").select(F.col("src").alias("question"), kind.alias("kind"), F.col("dst").alias("id"), F.col("confidence").alias("score"))
    members = links.where("rel_type = 'LOCATED_IN'").select(F.col("src").alias("id"), F.concat(F.lit("K:"), "dst").alias("community"))
    return S.seed_subgraphs(links, topics, members)


def _hop(h: int) -> str:
    """One round of the expansion as CTEs."""
    return (
        f"room{h} AS (SELECT question, count(*) AS n, greatest({S.QUOTA}, ({S.CAPACITY} - count(*)) // count(*) FILTER (distance = {h - 1})) AS quota FROM k{h - 1} JOIN depths USING (question) "
        f"WHERE depth >= {h} GROUP BY question HAVING count(*) < {S.CAPACITY} AND count(*) FILTER (distance = {h - 1}) > 0), "
        f"x{h} AS (SELECT f.question, a, b, rel_type, position AS turn, r, n FROM k{h - 1} f JOIN room{h} USING (question) JOIN near ON a = f.id WHERE f.distance = {h - 1} AND r <= quota "
        f"AND NOT EXISTS (SELECT 1 FROM k{h - 1} k WHERE k.question = f.question AND k.id = b) QUALIFY row_number() OVER (PARTITION BY f.question, b ORDER BY turn, r) = 1), "
        f"y{h} AS MATERIALIZED (SELECT *, n + row_number() OVER (PARTITION BY question ORDER BY turn, r) AS position FROM x{h} QUALIFY position <= {S.CAPACITY}), "
        f"k{h} AS MATERIALIZED (SELECT question, id, distance, position FROM k{h - 1} UNION ALL SELECT question, b, {h}, position FROM y{h}), "
    )


#: Two products of a question share its supplier, so the shortest path between them is over the least supplier that they share.
_SUBGRAPHS = (
    f"WITH {EDGES}, both_ways AS MATERIALIZED (SELECT src AS a, dst AS b, rel_type FROM edges UNION SELECT dst, src, rel_type FROM edges), "
    f"topics AS (SELECT src AS question, {_KINDS!r}[CAST(substr(src, 3) AS INT) % {len(_KINDS)} + 1] AS kind, dst AS id, confidence AS score FROM edges WHERE rel_type = 'PRODUCES'), "
    f"seeds AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS position FROM topics QUALIFY position <= {S.SEEDS}), "
    f"depths AS MATERIALIZED (SELECT DISTINCT question, CASE kind {' '.join(f'WHEN {k!r} THEN {v}' for k, v in S.HOPS.items())} ELSE 2 END AS depth FROM seeds), "
    "k0 AS MATERIALIZED (SELECT question, id, 0 AS distance, position FROM seeds), "
    f"near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b, rel_type) AS r FROM both_ways QUALIFY r <= {S.CAPACITY}), {_hop(1)}{_hop(2)}{_hop(3)}"
    "pairs AS (SELECT question, x.id AS s, y.id AS e, x.position AS i, y.position AS j FROM seeds x JOIN seeds y USING (question) JOIN depths USING (question) WHERE depth >= 2 AND x.position < y.position), "
    "over AS (SELECT question, i, j, min(l.b) AS id FROM pairs JOIN both_ways l ON l.a = s JOIN both_ways r ON r.a = e AND r.b = l.b GROUP BY question, i, j), "
    "bridge AS (SELECT question, id, min((i, j)) AS met FROM over WHERE NOT EXISTS (SELECT 1 FROM k3 WHERE k3.question = over.question AND k3.id = over.id) GROUP BY question, id), "
    "m AS MATERIALIZED (SELECT question, id, distance, CASE WHEN distance = 0 THEN score ELSE round(greatest(0.3, 0.9 - distance * 0.15), 6) END AS relevance, "
    "CASE WHEN distance = 0 THEN 'seed' ELSE 'neighbor' END AS origin, k3.position FROM k3 LEFT JOIN seeds USING (question, id) UNION ALL "
    "SELECT question, id, 1, 0.85, 'bridge', (SELECT count(*) FROM k3 WHERE k3.question = bridge.question) + row_number() OVER (PARTITION BY question ORDER BY met, id) FROM bridge), "
    f"held AS MATERIALIZED (SELECT question, id, 'K:' || dst AS community FROM m JOIN edges ON src = id AND edges.rel_type = 'LOCATED_IN' WHERE position <= {S.ASKING}), "
    f"groups AS MATERIALIZED (SELECT question, community, row_number() OVER (PARTITION BY question ORDER BY community) AS r FROM (SELECT DISTINCT question, community FROM held) QUALIFY r <= {S.COMMUNITIES}) "
)


@query(
    _SUBGRAPHS + "SELECT question, id, CAST(distance AS INT) AS distance, CAST(relevance AS DOUBLE) AS relevance, origin, CAST(position AS INT) AS position FROM m UNION ALL "
    "SELECT question, community, 1, 0.6, 'community', CAST((SELECT count(*) FROM m WHERE m.question = groups.question) + r AS INT) FROM groups"
)
def seed_subgraph_nodes(spark, sf_dir):
    """Nodes of each supplier's subgraph around its five best products, in the order in which they were found."""
    return _subgraphs(spark, sf_dir)[0]


@query(
    _SUBGRAPHS + "SELECT question, a AS src, b AS dst, rel_type FROM y1 UNION SELECT question, a, b, rel_type FROM y2 UNION SELECT question, a, b, rel_type FROM y3 UNION "
    "SELECT s.question, src, dst, rel_type FROM edges JOIN m s ON s.id = src JOIN m d ON d.question = s.question AND d.id = dst WHERE s.question IN (SELECT question FROM pairs) UNION "
    "SELECT question, id, community, 'BELONGS_TO' FROM held JOIN groups USING (question, community)"
)
def seed_subgraph_edges(spark, sf_dir):
    """Edges of the same subgraphs: those that were walked, those among their nodes, and those to communities."""
    return _subgraphs(spark, sf_dir)[1]
