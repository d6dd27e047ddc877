"""Queries of a stored graph after two incremental loads of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..session import table
from ..streaming import loads
from .model import EDGES, ENTITIES, edges, entities
from .registry import query

_NAMES = [c.split()[0] for c in loads.RECORDS.split(", ")]


def _records(df, kind, loaded_at, **values):
    """Records of a kind, with nulls for what it lacks."""
    types = dict(c.split() for c in loads.RECORDS.split(", "))
    made = {"kind": F.lit(kind), "loaded_at": F.lit(loaded_at).cast("timestamp")} | {k: F.expr(v) for k, v in values.items()}
    return df.select(*(made.get(c, F.lit(None)).cast(types[c]).alias(c) for c in _NAMES))


def _loaded(spark, sf_dir):
    """The path of a store: first all but products, with relations of products that wait; then all entities, partly changed."""
    path = f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    nodes, links = entities(spark, sf_dir), edges(spark, sf_dir)
    told = {"id": "id", "name": "name", "type": "type", "confidence": "confidence", "chunk_ids": "CASE WHEN id LIKE 'C:%' THEN array(replace(id, 'C:', 'D:')) END"}
    ends = {"src": "src", "predicate": "rel_type", "dst": "dst"}
    first = _records(nodes.where("id not like 'P:%'"), "entity", "2024-01-01", **told, description="description", embedding="array(confidence)")
    first = first.unionAll(_records(links, "relation", "2024-01-01", **ends, confidence="floor(confidence * 8) / 8"))
    first = first.unionAll(_records(table(spark, sf_dir, "documents"), "chunk", "2024-01-01", id="concat('D:', doc_id)", doc_id="doc_id", position="0", text="text"))
    loads.load(first, path, "tables", 0)
    revised = {"description": "CASE WHEN confidence < 0.3 THEN concat('revised ', coalesce(description, '')) ELSE description END", "embedding": "array(CASE WHEN version = 2 THEN confidence + 1 ELSE confidence END)"}
    second = _records(nodes, "entity", "2024-02-01", **told, **revised)
    second = second.unionAll(_records(links, "relation", "2024-02-01", **ends, confidence="floor(confidence * 8) / 8 + (weight % 4) / 16"))
    loads.load(second, path, "tables", 1)
    return path


_CHANGED = "CASE WHEN id LIKE 'P:%' THEN 'NEW' WHEN confidence < 0.3 THEN 'MODIFIED' WHEN version = 2 THEN 'EMBEDDING_ONLY' ELSE 'UNCHANGED' END"


@query(
    f"WITH {ENTITIES}, {EDGES}, counted AS (SELECT 0 AS number, 'chunk' AS kind, 'NEW' AS change, count(*) AS n FROM documents "
    "UNION ALL SELECT 0, 'entity', unnest(['NEW', 'WITH_VECTOR']), count(*) FROM entities WHERE id NOT LIKE 'P:%' "
    "UNION ALL SELECT unnest([0, 1]), 'link', unnest(['NEW', 'UNCHANGED']), count(*) FROM customer "
    "UNION ALL SELECT 0, 'relation', 'NEW', count(*) FROM edges "
    f"UNION ALL SELECT 1, 'entity', {_CHANGED}, count(*) FROM entities GROUP BY ALL UNION ALL SELECT 1, 'entity', 'WITH_VECTOR', count(*) FROM entities "
    "UNION ALL SELECT 1, 'relation', CASE WHEN weight % 4 >= 2 THEN 'MODIFIED' ELSE 'UNCHANGED' END, count(*) FROM edges GROUP BY ALL) "
    "SELECT number, kind, change, n FROM counted WHERE n > 0"
)
def load_report(spark, sf_dir):
    """What two loads of the tables changed, by kind."""
    return loads.report(spark, _loaded(spark, sf_dir))


@query(
    f"WITH {ENTITIES}, {EDGES} SELECT 'entity' AS kind, id AS key, CAST(CASE WHEN id NOT LIKE 'P:%' AND confidence < 0.3 THEN 2 ELSE 1 END AS INT) AS version, "
    "round(confidence + CASE WHEN version = 2 THEN 1 ELSE 0 END, 4) AS value, "
    "CAST(CASE WHEN id LIKE 'P:%' OR confidence < 0.3 OR version = 2 THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS VARCHAR) AS updated FROM entities "
    "UNION ALL SELECT 'relation', concat_ws(' ', src, rel_type, dst), CAST(CASE WHEN weight % 4 >= 2 THEN 2 ELSE 1 END AS INT), "
    "floor(confidence * 8) / 8 + CASE WHEN weight % 4 >= 2 THEN (weight % 4) / 16.0 ELSE 0 END, CASE WHEN weight % 4 >= 2 THEN '2024-02-01' ELSE '2024-01-01' END FROM edges "
    "UNION ALL SELECT 'link', concat('D:', doc_id, ' C:', doc_id), 1, NULL, '2024-01-01' FROM documents JOIN customer ON c_custkey = doc_id"
)
def loaded_graph(spark, sf_dir):
    """Entities (value: their vector), relations (value: their confidence) and links as stored after two loads."""
    path = _loaded(spark, sf_dir)
    at = F.date_format("updated_at", "yyyy-MM-dd").alias("updated")
    row = lambda name, key, value, column: loads.stored(spark, path, name, ["version", "updated_at", *column]).select(F.lit(name).alias("kind"), key.alias("key"), "version", value.alias("value"), at)
    out = row("entity", F.col("id"), F.round(F.col("embedding")[0].cast("double"), 4), ["embedding"]).unionAll(row("relation", F.concat_ws(" ", "src", "predicate", "dst"), F.col("confidence"), ["confidence"]))
    return out.unionAll(row("link", F.concat_ws(" ", "chunk_id", "entity_id"), F.lit(None).cast("double"), []))
