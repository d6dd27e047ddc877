"""The property graph as DataFrames, derived from the star-schema tables; and the same as DuckDB CTEs for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Entities: a label's key prefix, and per table its columns as SQL that Spark and DuckDB both read.
ENTITY_SQL = {
    "region": ("concat('R:', r_regionkey)", "r_name", "'LOCATION'", "''", "0.95", "false", "1", "DATE '2020-01-01'"),
    "nation": ("concat('N:', n_nationkey)", "n_name", "'LOCATION'", "concat('nation of region ', n_regionkey)", "0.9", "false", "1", "DATE '2020-01-01'"),
    "customer": ("concat('C:', c_custkey)", "c_name", "'ORGANIZATION'", "c_mktsegment", "((c_custkey * 37) % 100) / 100.0", "CASE WHEN c_acctbal < 0 THEN true WHEN c_custkey % 7 = 0 THEN NULL ELSE false END", "CAST(c_custkey % 4 AS INT)", "DATE '2021-01-01'"),
    "supplier": ("concat('S:', s_suppkey)", "s_name", "'ORGANIZATION'", "CAST(NULL AS STRING)", "((s_suppkey * 53) % 100) / 100.0", "CASE WHEN s_acctbal < 0 THEN true ELSE false END", "1", "DATE '2022-06-01'"),
    "part": ("concat('P:', p_partkey)", "p_name", "'PRODUCT'", "p_type", "((p_partkey * 29) % 100) / 100.0", "CASE WHEN p_size = 1 THEN true ELSE false END", "CAST(p_size % 3 AS INT)", "DATE '2023-03-01'"),
}
_COLUMNS = ("id", "name", "type", "description", "confidence", "is_deleted", "version", "created_on")

EDGE_SQL = {
    "customer": ("concat('C:', c_custkey)", "concat('N:', c_nationkey)", "'LOCATED_IN'", "((c_custkey * 41) % 100) / 100.0", "1"),
    "supplier": ("concat('S:', s_suppkey)", "concat('N:', s_nationkey)", "'LOCATED_IN'", "((s_suppkey * 17) % 100) / 100.0", "1"),
    "nation": ("concat('N:', n_nationkey)", "concat('R:', n_regionkey)", "'PART_OF'", "0.9", "1"),
}


def _cast(name: str, sql: str) -> str:
    kind = {"confidence": "DOUBLE", "is_deleted": "BOOLEAN", "version": "INT"}.get(name)
    return f"CAST({sql} AS {kind}) AS {name}" if kind else f"{sql} AS {name}"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, type, description, confidence, is_deleted, version, created_on of all nodes."""
    out = None
    for name, columns in ENTITY_SQL.items():
        part = table(spark, sf_dir, name).selectExpr(*(_cast(c, s) for c, s in zip(_COLUMNS, columns, strict=True)))
        out = part if out is None else out.unionByName(part)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, rel_type, confidence, weight: places of customers, suppliers and nations, and products of suppliers."""
    out = None
    for name, columns in EDGE_SQL.items():
        src, dst, kind, confidence, weight = columns
        part = table(spark, sf_dir, name).selectExpr(f"{src} AS src", f"{dst} AS dst", f"{kind} AS rel_type", f"CAST({confidence} AS DOUBLE) AS confidence", f"CAST({weight} AS BIGINT) AS weight")
        out = part if out is None else out.unionByName(part)
    made = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("weight"))
    made = made.select(
        F.concat(F.lit("S:"), "l_suppkey").alias("src"), F.concat(F.lit("P:"), "l_partkey").alias("dst"), F.lit("PRODUCES").alias("rel_type"),
        (F.pmod(F.col("l_suppkey") * 7 + F.col("l_partkey") * 3, F.lit(100)) / 100.0).cast("double").alias("confidence"), "weight",
    )
    return out.unionByName(made)


def _duck_entities() -> str:
    parts = (f"SELECT {', '.join(_cast(c, s) for c, s in zip(_COLUMNS, columns, strict=True))} FROM {name}" for name, columns in ENTITY_SQL.items())
    return " UNION ALL ".join(parts)


def _duck_edges() -> str:
    parts = [f"SELECT {s} AS src, {d} AS dst, {k} AS rel_type, CAST({c} AS DOUBLE) AS confidence, CAST({w} AS BIGINT) AS weight FROM {name}" for name, (s, d, k, c, w) in EDGE_SQL.items()]
    parts.append(
        "SELECT concat('S:', l_suppkey), concat('P:', l_partkey), 'PRODUCES', CAST(((l_suppkey * 7 + l_partkey * 3) % 100) / 100.0 AS DOUBLE), count(*) "
        "FROM lineitem GROUP BY l_suppkey, l_partkey"
    )
    return " UNION ALL ".join(parts)


#: To put before an oracle's SELECT.
ENTITIES = f"entities AS ({_duck_entities()})"
EDGES = f"edges AS ({_duck_edges()})"
GRAPH = f"WITH {ENTITIES}, {EDGES}, both_ways AS (SELECT src AS a, dst AS b, rel_type, confidence FROM edges UNION ALL SELECT dst, src, rel_type, confidence FROM edges) "
CHUNKS = (
    "WITH chunks AS (SELECT doc_id, pos, substr(text, CAST(pos * 800 + 1 AS BIGINT), 1000) AS text, pos * 800 AS start_char FROM "
    "(SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 1000 THEN 1 ELSE CAST(ceil((length(text) - 200) / 800.0) AS BIGINT) END)) AS pos FROM documents WHERE length(trim(text)) > 0)) "
)


def undirected(edge: DataFrame) -> DataFrame:
    """a, b, rel_type, confidence: every edge seen from both ends."""
    there = edge.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type", "confidence")
    return there.unionByName(edge.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel_type", "confidence"))


def chunks(documents: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """doc_id, pos, text, start_char: windows of `size` characters that overlap; blank documents have none."""
    step = size - overlap
    n = F.when(F.length("text") <= size, 1).otherwise(F.ceil((F.length("text") - overlap) / F.lit(float(step)))).cast("int")
    rows = documents.where(F.length(F.trim("text")) > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.substring("text", F.col("pos") * step + 1, F.lit(size)).alias("text"), (F.col("pos") * step).cast("long").alias("start_char"))
