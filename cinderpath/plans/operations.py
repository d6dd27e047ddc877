"""Queries on sources, streams' table twins and the ontology."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ontology as O
from ..session import table
from ..sources import loaders
from ..streaming import state as S
from ..streaming.alert_history import history
from .model import GRAPH, edges, entities
from .registry import query


@query(
    "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), "
    "'<[^>]+>', ' ', 'g'), '&[A-Za-z]+;', ' ', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g')) AS text FROM pages"
)
def html_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", loaders.html_text("html").alias("text"))


@query(
    "SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(count_if(event_type = 'error') / count(*), 6) AS error_rate, round(avg(value), 6) AS latency FROM events GROUP BY 1"
)
def hourly_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"), "value")
    return S.rates(rows).select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("error_rate", 6).alias("error_rate"), F.round("latency", 6).alias("latency"))


@query(
    "WITH w AS (SELECT date_trunc('day', ts) AS start, count(*) AS n, count_if(event_type = 'error') / count(*) AS error_rate, avg(value) AS latency FROM events GROUP BY 1) "
    "SELECT start, 'error_rate' AS rule, round(error_rate, 6) AS value FROM w WHERE n >= 10 AND error_rate > 0.2 UNION ALL SELECT start, 'latency', round(latency, 6) FROM w WHERE n >= 10 AND latency > 50"
)
def daily_alerts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"), "value")
    return S.alerts(S.rates(rows, "1 day"), 0.2, 50).select(F.col("start").cast("timestamp_ntz").alias("start"), "rule", "value")


@query(
    "WITH RECURSIVE c AS MATERIALIZED (SELECT user_id AS k, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS t, count_if(event_type = 'error') / count(*) AS v, "
    "row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) AS r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id, date_trunc('day', ts)), "
    "s AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS fired, false AS active, CAST(0 AS BIGINT) AS last, CAST([] AS STRUCT(tm BIGINT, status VARCHAR, value DOUBLE)[]) AS told FROM c "
    "UNION ALL SELECT k, r, CASE WHEN fires THEN t ELSE fired END, fires OR (awake AND bad), t, list_concat("
    "CASE WHEN active AND NOT awake THEN [{'tm': last + 604800, 'status': 'RESOLVED', 'value': CAST(NULL AS DOUBLE)}] ELSE [] END, "
    "CASE WHEN fires THEN [{'tm': t, 'status': 'FIRING', 'value': v}] WHEN awake AND NOT bad THEN [{'tm': t, 'status': 'RESOLVED', 'value': v}] ELSE [] END) "
    "FROM (SELECT c.k, c.r, c.t, c.v, s.fired, s.active, s.last, c.v > 0.2 AS bad, s.active AND c.t - s.last < 604800 AS awake, "
    "c.v > 0.2 AND (s.fired IS NULL OR c.t - s.fired >= 259200) AS fires FROM s JOIN c ON c.k = s.k AND c.r = s.r + 1)), "
    "e AS (SELECT k, unnest(told) AS x FROM s WHERE r > 0) SELECT CAST(k AS VARCHAR) AS key, x.tm AS at, x.status AS status, round(x.value, 6) AS value FROM e"
)
def alert_history(spark, sf_dir):
    """Alerts of users whose daily share of errors passes a fifth: at most one in three days, resolved by a good day or a week of silence."""
    days = table(spark, sf_dir, "events").where("user_id is not null and ts is not null").groupBy(F.col("user_id").alias("key"), F.to_date("ts").alias("day"))
    rate = days.agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("value"))
    checks = rate.select("key", (F.unix_date("day").cast("long") * 86_400_000).alias("at"), (F.col("value") > 0.2).alias("broken"), "value")
    told = history(checks, 3 * 86_400_000, 7 * 86_400_000)
    return told.select("key", F.expr("at div 1000").alias("at"), "status", F.round("value", 6).alias("value"))


@query(
    "WITH RECURSIVE e AS (SELECT user_id AS k, event_id AS id, epoch(ts) AS sec, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), "
    "s AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS id, 'closed' AS state, CAST([] AS DOUBLE[]) AS fails, CAST(0.0 AS DOUBLE) AS opened, 0 AS good, '' AS outcome FROM e "
    "UNION ALL SELECT k, r, id, CASE WHEN now = 'half_open' AND failed OR now = 'closed' AND failed AND len(more) >= 3 THEN 'open' WHEN now = 'half_open' AND g + 1 >= 2 THEN 'closed' ELSE now END, "
    "CASE WHEN now = 'half_open' AND NOT failed AND g + 1 >= 2 THEN CAST([] AS DOUBLE[]) WHEN now = 'closed' THEN more ELSE fails END, "
    "CASE WHEN now = 'half_open' AND failed OR now = 'closed' AND failed AND len(more) >= 3 THEN sec ELSE opened END, CASE WHEN now = 'half_open' AND NOT failed THEN g + 1 ELSE g END, "
    "CASE WHEN now = 'open' THEN 'rejected' WHEN now = 'half_open' AND failed OR now = 'closed' AND failed AND len(more) >= 3 THEN 'open' WHEN now = 'half_open' AND g + 1 >= 2 THEN 'closed' ELSE now END "
    "FROM (SELECT *, CASE WHEN now = 'closed' AND failed THEN list_append(list_filter(fails, lambda t: sec - t <= 432000), sec) ELSE fails END AS more FROM "
    "(SELECT e.k, e.r, e.id, e.sec, e.failed, s.fails, s.opened, CASE WHEN s.state = 'open' AND e.sec - s.opened >= 86400 THEN 'half_open' ELSE s.state END AS now, "
    "CASE WHEN s.state = 'open' AND e.sec - s.opened >= 86400 THEN 0 ELSE s.good END AS g FROM s JOIN e ON e.k = s.k AND e.r = s.r + 1))) "
    "SELECT CAST(k AS VARCHAR) AS key, id, outcome FROM s WHERE r > 0"
)
def breaker_outcomes(spark, sf_dir):
    """Breakers a user, over error events, with limits that suit these sparse events."""
    rows = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp").cast("double")
    return S.breaker(rows.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), at.alias("at"), (F.col("event_type") == "error").alias("failed")), window=86400 * 5, limit=3, wait=86400.0, close=2)


_RULES = [("LOCATED_IN", "ORGANIZATION", "LOCATION", "N:1"), ("PART_OF", "LOCATION", "LOCATION", "N:1"), ("PRODUCES", "ORGANIZATION", "ORGANIZATION", "1:N")]
_VALUES = ", ".join(str(r) for r in _RULES)


def _rules(spark):
    return spark.createDataFrame(_RULES, "rel_type string, source_type string, target_type string, cardinality string")


@query(
    GRAPH + f", rule(rel_type, source_type, target_type, cardinality) AS (VALUES {_VALUES}) SELECT rel_type, count(*) AS n, count_if(a.type <> source_type) AS bad_source, count_if(b.type <> target_type) AS bad_target "
    "FROM edges JOIN rule USING (rel_type) JOIN entities a ON a.id = src JOIN entities b ON b.id = dst GROUP BY rel_type"
)
def type_violations(spark, sf_dir):
    return O.type_violations(edges(spark, sf_dir), entities(spark, sf_dir), _rules(spark))


@query(
    GRAPH + f", rule(rel_type, source_type, target_type, cardinality) AS (VALUES {_VALUES}), t AS (SELECT rel_type, dst, count(DISTINCT src) AS n FROM edges JOIN rule USING (rel_type) WHERE cardinality IN ('1:1', '1:N') GROUP BY ALL HAVING count(DISTINCT src) > 1), "
    "s AS (SELECT rel_type, src, count(DISTINCT dst) AS n FROM edges JOIN rule USING (rel_type) WHERE cardinality IN ('1:1', 'N:1') GROUP BY ALL HAVING count(DISTINCT dst) > 1) "
    "SELECT rel_type, dst AS id, 'several_sources' AS fault, n FROM t UNION ALL SELECT rel_type, src, 'several_targets', n FROM s"
)
def cardinality_violations(spark, sf_dir):
    return O.cardinality_violations(edges(spark, sf_dir), _rules(spark))


@query(GRAPH + "SELECT name, type, count(*) AS n FROM entities GROUP BY name, type HAVING count(*) > 1")
def uniqueness_violations(spark, sf_dir):
    return O.duplicates(entities(spark, sf_dir), ["name", "type"])
