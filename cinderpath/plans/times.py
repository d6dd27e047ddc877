"""Time expressions of sentences made of orders; weights of relations and relevance by distance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import temporal as T
from ..operators import graph as G
from ..session import table
from .graphs import _SMALL, _places, _regions
from .model import GRAPH, edges, undirected
from .registry import query

#: A sentence an order; Spark and DuckDB differ in the formats of dates alone.
_TEXT = (
    "CASE o_orderkey % 7 WHEN 0 THEN concat('Ordered on ', {day}, ' and not 1996-02-30.') WHEN 1 THEN concat('Shipped after ', {month}, ', see 1995 and 1995.') "
    "WHEN 2 THEN concat('Billed in Q', quarter(o_orderdate), ' ', year(o_orderdate), ' or 1994 q2.') WHEN 3 THEN concat('Through the 1990s, before ', year(o_orderdate), '.') "
    "WHEN 4 THEN concat('Around ', year(o_orderdate), ', during last month.') WHEN 5 THEN concat('Year ', year(o_orderdate), ' from 2020 on.') ELSE 'Nothing dated.' END"
)


def _all(pattern: str, flags: str = "") -> str:
    return f"regexp_extract_all(text, '{pattern}', 0, '{flags}')"


def _unnest(kind: str, found: str, start: str, end: str) -> str:
    c = T.CONFIDENCE[kind]
    return f"SELECT id, '{kind}' AS kind, m AS raw, TRY_CAST({start} AS DATE) AS start, TRY_CAST({end} AS DATE) AS \"end\", CAST({c} AS DOUBLE) AS confidence FROM (SELECT id, unnest({found}) AS m FROM s)"


_Y = "CAST(regexp_extract(m, '\\d{4}') AS INT)"
_M = f"lpad(CAST(list_position({list(T.MONTHS)}, lower(regexp_extract(m, '^[A-Za-z]+'))) AS VARCHAR), 2, '0')"
_Q = "CAST(regexp_extract(m, '[Qq]([1-4])', 1) AS INT) * 3"
_FOUND = (
    f"WITH s AS (SELECT o_orderkey AS id, {_TEXT.format(day="strftime(o_orderdate, '%Y-%m-%d')", month="strftime(o_orderdate, '%B %Y')")} AS text FROM orders), d AS ("
    + " UNION ALL ".join([
        _unnest("exact_date", _all(T.ISO_DATE), "m", "m"),
        _unnest("month", _all(T.MONTH_YEAR, "i"), f"concat({_Y}, '-', {_M}, '-01')", f"concat({_Y}, '-', {_M}, '-28')"),
        _unnest("quarter", _all(T.QUARTER), f"concat({_Y}, '-', lpad(CAST({_Q} - 2 AS VARCHAR), 2, '0'), '-01')", f"concat({_Y}, '-', lpad(CAST({_Q} AS VARCHAR), 2, '0'), '-28')"),
        _unnest("decade", _all(T.DECADE), f"concat({_Y}, '-01-01')", f"concat({_Y} + 9, '-12-31')"),
        _unnest("approximate", _all(T.ABOUT, "i"), f"concat({_Y} - 2, '-01-01')", f"concat({_Y} + 2, '-12-31')"),
    ])
    + f"), k AS (SELECT * FROM d WHERE start IS NOT NULL), y AS ({_unnest('year', f'list_distinct({_all(T.YEAR)})', f"concat({_Y}, '-01-01')", f"concat({_Y}, '-12-31')")}), "
    "e AS (SELECT * FROM k UNION ALL SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.id = y.id AND year(k.start) = year(y.start))) "
)


def _sentences(spark, sf_dir):
    text = _TEXT.format(day="date_format(o_orderdate, 'yyyy-MM-dd')", month="date_format(o_orderdate, 'MMMM yyyy')")
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{text} AS text")


@query(_FOUND + "SELECT id, kind, raw, start, \"end\", confidence FROM e")
def time_expressions(spark, sf_dir):
    return _sentences(spark, sf_dir).select("id", F.explode(T.expressions(F.col("text"))).alias("e")).select("id", "e.*")


@query(
    _FOUND + f", b AS (SELECT id, max(confidence) AS c FROM e GROUP BY id), o AS (SELECT id, regexp_matches(text, '{T.BEFORE}', 'i') AS before, regexp_matches(text, '{T.AFTER}', 'i') AS after, "
    f"regexp_matches(text, '{T.DURING}', 'i') AS during, CAST(len({_all(T.RELATIVE, 'i')}) AS INT) AS n_relative FROM s) "
    "SELECT o.id, (SELECT arg_min(kind, kind) FROM e WHERE e.id = o.id AND e.confidence = b.c) AS kind, before, after, during, n_relative FROM o LEFT JOIN b ON b.id = o.id"
)
def primary_timeframes(spark, sf_dir):
    rows = _sentences(spark, sf_dir).select("id", T.primary(F.col("text"))["kind"].alias("kind"), T.orders(F.col("text")).alias("o"), F.size(T.relative_words(F.col("text"))).alias("n_relative"))
    return rows.select("id", "kind", *(F.array_contains("o", w.upper()).alias(w) for w in ("before", "after", "during")), "n_relative")


@query(
    GRAPH + "SELECT src, dst, rel_type, round(least(1.0, confidence * 0.4 + least(greatest(weight, 1) / 10.0, 1.0) * 0.3 + CASE WHEN regexp_matches(lower(rel_type), 'related|associated|connected|linked') THEN 0.1 "
    "WHEN length(rel_type) > 3 THEN 0.25 ELSE 0.15 END), 6) AS relation_weight FROM edges"
)
def relation_weights(spark, sf_dir):
    weight = E.relation_weight(F.col("confidence"), F.col("weight"), F.col("rel_type"))
    return edges(spark, sf_dir).select("src", "dst", "rel_type", F.round(weight, 6).alias("relation_weight"))


@query(
    GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _SMALL + ", r(start, node, distance) AS (SELECT id, id, 0 FROM entities WHERE id LIKE 'R:%' UNION SELECT start, b, distance + 1 FROM r JOIN both_small ON a = node WHERE distance < 3), "
    "m AS (SELECT start, node, min(distance) AS d FROM r GROUP BY ALL) SELECT start, node, round(CAST(greatest(0.3, 1 - d * 0.2) AS DOUBLE), 6) AS relevance, round(CAST(greatest(0.3, 0.9 - d * 0.15) AS DOUBLE), 6) AS seed_relevance FROM m"
)
def relevance_by_distance(spark, sf_dir):
    near = G.reach(_places(spark, sf_dir), _regions(spark, sf_dir), 3)
    d = F.col("distance")
    return near.select("start", "node", F.round(E.node_relevance(d), 6).alias("relevance"), F.round(E.node_relevance(d, seed=True), 6).alias("seed_relevance"))


@query()
def whole_graph_relevance(spark, sf_dir):
    """relevance_by_distance over all edges, products too."""
    near = G.reach(undirected(edges(spark, sf_dir)), _regions(spark, sf_dir), 3)
    d = F.col("distance")
    return near.select("start", "node", F.round(E.node_relevance(d), 6).alias("relevance"), F.round(E.node_relevance(d, seed=True), 6).alias("seed_relevance"))
