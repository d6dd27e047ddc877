"""Queries over a written text index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text_index as X
from ..operators.graph import shared_folder
from ..session import table
from .model import ENTITIES, entities
from .registry import ORACLE_SQL, query

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_LABELLED = (
    f"WITH {ENTITIES}, d AS MATERIALIZED (SELECT label, id, {_WORDS} AS ws FROM (SELECT 'Entity' AS label, id, concat_ws(' ', name, description) AS text FROM entities UNION ALL "
    "SELECT 'Chunk', concat('D:', doc_id), text FROM documents UNION ALL SELECT 'Community', concat('K:', p_brand), concat_ws(' ', p_brand, array_to_string(list_sort(list_distinct(list(p_name))), ', ')) FROM part GROUP BY p_brand)), "
    f"q AS MATERIALIZED (SELECT query_id, unnest(list_distinct({_WORDS})) AS w FROM (SELECT DISTINCT p_name AS query_id, p_name AS text FROM part)), "
    "n AS (SELECT label, count(*) AS n, avg(len(ws)) AS al FROM d GROUP BY label), t AS (SELECT label, id, len(ws) AS l, unnest(ws) AS w FROM d), "
    "tf AS MATERIALIZED (SELECT label, id, l, w, count(*) AS tf FROM t WHERE w IN (SELECT w FROM q) GROUP BY ALL), df AS (SELECT label, w, count(*) AS df FROM tf GROUP BY label, w), "
    "s AS (SELECT query_id, label, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score FROM tf JOIN df USING (label, w) JOIN q USING (w) JOIN n USING (label) GROUP BY query_id, label, id), "
    "r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS place FROM s WHERE score > 0) "
)


def _index(spark: SparkSession, documents: DataFrame) -> X.Index:
    return X.write_index(documents, f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}")


def _labelled(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = entities(spark, sf_dir).select(F.lit("Entity").alias("label"), "id", F.concat_ws(" ", "name", "description").alias("text"))
    chunks = table(spark, sf_dir, "documents").select(F.lit("Chunk"), F.concat(F.lit("D:"), "doc_id"), "text")
    brands = part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ", ").alias("names"))
    brands = brands.select(F.lit("Community"), F.concat(F.lit("K:"), "p_brand"), F.concat_ws(" ", "p_brand", "names"))
    return names.unionAll(chunks).unionAll(brands), part.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("text")).distinct()


@query()
def indexed_text_search(spark, sf_dir):
    """The rows of text_search, from the blocks that can hold them."""
    docs = table(spark, sf_dir, "documents").select(F.lit("Chunk").alias("label"), F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("Chunk").alias("label"), "text")
    return X.search(_index(spark, docs), asked, 10).rows.select("query_id", "id", F.round("score", 4).alias("score"))


ORACLE_SQL["indexed_text_search"] = ORACLE_SQL["text_search"]


@query(
    _LABELLED + ", o AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, label) AS once FROM r WHERE place <= 5), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label, id) AS pick FROM o WHERE once = 1) SELECT query_id, label, id, round(score, 4) AS score FROM p WHERE pick <= 10"
)
def labelled_text_search(spark, sf_dir):
    """Names of parts, sought among entities, documents and brands, a few of each label at most."""
    docs, asked = _labelled(spark, sf_dir)
    found = X.search_all(_index(spark, docs), asked, 10, ["Entity", "Chunk", "Community"])
    return found.select("query_id", "label", "id", F.round("score", 4).alias("score"))


@query(
    _LABELLED + ", f AS MATERIALIZED (SELECT query_id, id, score FROM r WHERE label = 'Community' AND place <= 5 AND score >= 0.5), "
    "g AS (SELECT p_name AS query_id, p_brand, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey, concat('P:', p_partkey)) AS k FROM part), "
    "c AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM (SELECT DISTINCT query_id, concat('K:', p_brand) AS id FROM g WHERE k <= 10)) "
    "SELECT query_id, id, round(score, 4) AS score, 'community_search' AS source FROM f UNION ALL SELECT query_id, id, 0.7, 'connected_community' FROM c WHERE k <= 5 AND (query_id, id) NOT IN (SELECT query_id, id FROM f)"
)
def communities_of_queries(spark, sf_dir):
    """Brands found by a part's name, and those of the parts of that name."""
    docs, asked = _labelled(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    key = F.concat(F.lit("P:"), "p_partkey").alias("id")
    members = part.select(key, F.concat(F.lit("K:"), "p_brand").alias("community"))
    found = X.community_search(_index(spark, docs.where("label = 'Community'")), asked, members, part.select(F.col("p_name").alias("query_id"), key, F.col("p_partkey").alias("place")))
    return found.select("query_id", "id", F.round("score", 4).alias("score"), "source")
