"""Queries of entity resolution by leaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leaders
from ..session import table
from .model import GRAPH, entities
from .registry import query

_NORM = "regexp_replace(regexp_replace(trim(lower(name)), '\\s+', ' ', 'g'), '^(the|a|an) ', '')"
_TOKENS = "list_distinct(list_transform(range(1, length(norm) + 2), lambda i: substr('^' || norm || '$', i, 2)))"
#: The stage at which a name joins a leader, from their names, token sets and vectors.
_STAGE = (
    "CASE WHEN len(list_intersect({x}.toks, {y}.toks)) >= ceil(0.5 * greatest(len({x}.toks), len({y}.toks))) AND (1 - levenshtein({x}.norm, {y}.norm) / CAST(greatest(length({x}.norm), length({y}.norm), 1) AS DOUBLE) >= 0.85 "
    "OR jaro_winkler_similarity({x}.norm, {y}.norm) >= 0.85) THEN 2 WHEN {x}.vec IS NOT NULL AND {y}.vec IS NOT NULL AND list_cosine_similarity({x}.vec, {y}.vec) >= 0.9 THEN 3 END"
)


@query(
    GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + f", m AS MATERIALIZED (SELECT id, type, {_NORM} AS norm FROM entities), "
    "g AS (SELECT type, norm, min(id) AS rep FROM m GROUP BY ALL), "
    f"u AS MATERIALIZED (SELECT g.*, {_TOKENS} AS toks, CAST(e.embedding AS DOUBLE[]) AS vec, row_number() OVER (ORDER BY md5(type || ':' || norm)) AS r FROM g LEFT JOIN embeddings e ON rep = concat('C:', e.vec_id)), "
    "step(r, led) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(r BIGINT, type VARCHAR, norm VARCHAR, toks VARCHAR[], vec DOUBLE[])[]) UNION ALL "
    f"SELECT u.r, CASE WHEN len(list_filter(led, lambda l: l.type = u.type AND ({_STAGE.format(x='u', y='l')}) IS NOT NULL)) > 0 THEN led "
    "ELSE list_append(led, struct_pack(r := u.r, type := u.type, norm := u.norm, toks := u.toks, vec := u.vec)) END FROM step JOIN u ON u.r = step.r + 1), "
    "leads AS MATERIALIZED (SELECT unnest(led) AS l FROM step WHERE r = (SELECT max(r) FROM u)), "
    f"joined AS (SELECT u.type, u.norm, u.rep, l.norm AS lead, CASE WHEN l.r = u.r THEN 0 ELSE {_STAGE.format(x='u', y='l')} END AS stage, l.r FROM u JOIN leads ON l.type = u.type AND l.r <= u.r), "
    "best AS (SELECT * FROM joined WHERE stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY type, norm ORDER BY stage, r) = 1) "
    "SELECT m.id, h.rep AS cluster, CASE WHEN m.id <> b.rep THEN 'exact' WHEN stage = 0 THEN 'leader' WHEN stage = 2 THEN 'fuzzy' ELSE 'embedding' END AS stage "
    "FROM m JOIN best b ON b.type = m.type AND b.norm = m.norm JOIN u h ON h.type = b.type AND h.norm = b.lead"
)
def leader_clusters(spark, sf_dir):
    """All entities by four-stage leader clustering, with the vectors of the customers that have one."""
    nodes = entities(spark, sf_dir).select("id", "type", "name")
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("C:"), "vec_id").alias("id"), F.col("embedding").alias("vector"))
    return leaders.leader_clusters(nodes, vectors)
