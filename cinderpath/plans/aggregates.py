"""Queries that summarise: counts, coverage, quality, percentiles, rankings and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..session import table
from .model import CHUNKS, GRAPH, chunks, edges, entities, undirected
from .registry import query


@query(GRAPH + "SELECT type, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM entities GROUP BY type")
def type_distribution(spark, sf_dir):
    return Q.distribution(entities(spark, sf_dir), "type")


@query(GRAPH + "SELECT a AS id, count(*) AS degree FROM both_ways GROUP BY a ORDER BY degree DESC, id LIMIT 10")
def top_degrees(spark, sf_dir):
    return undirected(edges(spark, sf_dir)).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(10)


@query(
    GRAPH + "SELECT type, count(*) AS total, count_if(description IS NOT NULL AND description <> '') AS covered, "
    "round(100.0 * count_if(description IS NOT NULL AND description <> '') / count(*), 1) AS pct FROM entities GROUP BY type"
)
def description_coverage(spark, sf_dir):
    full = (F.col("description").isNotNull() & (F.col("description") != "")).cast("long")
    covered = F.coalesce(F.sum(full), F.lit(0))
    return entities(spark, sf_dir).groupBy("type").agg(F.count("*").alias("total"), covered.alias("covered"), F.round(100.0 * covered / F.count("*"), 1).alias("pct"))


@query(GRAPH + "SELECT count(created_on) AS n, min(created_on) AS first, max(created_on) AS last, round(avg(version), 2) AS avg_version FROM entities")
def timestamp_stats(spark, sf_dir):
    return entities(spark, sf_dir).agg(F.count("created_on").alias("n"), F.min("created_on").alias("first"), F.max("created_on").alias("last"), F.round(F.avg("version"), 2).alias("avg_version"))


@query(
    GRAPH + "SELECT type, count_if(NOT coalesce(is_deleted, false)) AS active, count_if(coalesce(is_deleted, false)) AS deleted, "
    "count_if(coalesce(is_deleted, true)) AS deleted_or_unknown FROM entities GROUP BY type"
)
def deletion_stats(spark, sf_dir):
    gone = F.coalesce("is_deleted", F.lit(False))
    return entities(spark, sf_dir).groupBy("type").agg(F.count_if(~gone).alias("active"), F.count_if(gone).alias("deleted"), F.count_if(F.coalesce("is_deleted", F.lit(True))).alias("deleted_or_unknown"))


@query(
    GRAPH + "SELECT version, count_if(type = 'LOCATION') AS locations, count_if(type = 'ORGANIZATION') AS organizations, count_if(type = 'PRODUCT') AS products FROM entities GROUP BY version"
)
def version_pivot(spark, sf_dir):
    out = entities(spark, sf_dir).groupBy("version").pivot("type", ["LOCATION", "ORGANIZATION", "PRODUCT"]).count().na.fill(0)
    return out.select("version", F.col("LOCATION").alias("locations"), F.col("ORGANIZATION").alias("organizations"), F.col("PRODUCT").alias("products"))


@query(
    "SELECT l_suppkey AS id, min(l_returnflag) AS kind, max(l_extendedprice) AS best, count(DISTINCT l_partkey) AS n_parts, "
    "string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS aliases FROM lineitem GROUP BY l_suppkey"
)
def merged_entities(spark, sf_dir):
    """Rows of one id merged: the least kind, the greatest value, the union of names."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"))
    return rows.agg(
        F.min("l_returnflag").alias("kind"), F.max("l_extendedprice").alias("best"), F.countDistinct("l_partkey").alias("n_parts"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("aliases")
    )


@query(
    GRAPH + "SELECT type, count(*) AS n, round(avg(confidence), 6) AS mean, round(median(confidence), 6) AS middle, round(coalesce(stddev_samp(confidence), 0), 6) AS spread, "
    "min(confidence) AS low, max(confidence) AS high, count_if(confidence < 0.5) AS below FROM entities GROUP BY type"
)
def confidence_metrics(spark, sf_dir):
    return Q.confidence(entities(spark, sf_dir).groupBy("type"), "confidence", 0.5)


@query(
    CHUNKS + ", c AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id), d AS (SELECT doc_id, coalesce(n, 0) AS n FROM documents LEFT JOIN c USING (doc_id)) "
    "SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS chunks, round(avg(CASE WHEN n > 0 THEN n END), 6) AS mean_chunks, round(count_if(n = 0) / count(*), 6) AS empty_ratio, "
    "round(count_if(n > 5) / count(*), 6) AS dense_ratio FROM d"
)
def chunk_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id").join(chunks(docs).groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return counted.agg(
        F.count("*").alias("documents"), F.sum("n").alias("chunks"), F.round(F.avg(F.when(F.col("n") > 0, F.col("n"))), 6).alias("mean_chunks"),
        F.round(F.count_if(F.col("n") == 0) / F.count("*"), 6).alias("empty_ratio"), F.round(F.count_if(F.col("n") > 5) / F.count("*"), 6).alias("dense_ratio"),
    )


@query(
    "WITH f AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_size <= 30), t AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_size >= 20), "
    "m AS (SELECT f.name AS a, t.name AS b FROM f FULL JOIN t ON f.name = t.name), c AS (SELECT count_if(a IS NOT NULL AND b IS NOT NULL) AS tp, count_if(b IS NULL) AS fp, count_if(a IS NULL) AS fn FROM m) "
    "SELECT tp, fp, fn, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, "
    "round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 0.0001), 6) AS f1 FROM c"
)
def ground_truth(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return Q.precision_recall(part.where("p_size <= 30").select(F.col("p_name").alias("name")), part.where("p_size >= 20").select(F.col("p_name").alias("name")))


@query(
    GRAPH + ", e AS (SELECT count(*) AS n, avg(confidence) AS conf, count(DISTINCT type) AS kinds, avg(CASE WHEN coalesce(description, '') <> '' THEN 1.0 ELSE 0.0 END) AS described FROM entities), "
    "r AS (SELECT count(*) AS n FROM edges), l AS (SELECT count(DISTINCT x) AS n FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges)), "
    "s AS (SELECT 30 * conf + 25 * least(r.n / greatest(e.n, 1), 1) + 15 * least(kinds / 5.0, 1) + 20 * described + 10 * l.n / greatest(e.n, 1) AS score FROM e, r, l) "
    "SELECT round(score, 4) AS score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' WHEN score >= 40 THEN 'poor' ELSE 'critical' END AS level FROM s"
)
def quality_score(spark, sf_dir):
    return Q.score(entities(spark, sf_dir), edges(spark, sf_dir))


@query(
    GRAPH + ", t AS (SELECT type, count(*) AS n FROM entities GROUP BY type), s AS (SELECT sum(n) AS n FROM t), r AS (SELECT count(*) AS n FROM edges), "
    "d AS (SELECT count_if(coalesce(description, '') = '') / count(*) AS v FROM entities), c AS (SELECT avg(confidence) AS v FROM entities), "
    "u AS (SELECT count(*) AS n FROM (SELECT lower(name) FROM entities GROUP BY lower(name), type HAVING count(*) > 1)) "
    "SELECT 'type_imbalance' AS kind, round(max(t.n / s.n), 6) AS value FROM t, s HAVING max(t.n / s.n) > 0.5 "
    "UNION ALL SELECT 'low_confidence', round(v, 6) FROM c WHERE v < 0.6 UNION ALL SELECT 'missing_descriptions', round(v, 6) FROM d WHERE v > 0.5 "
    "UNION ALL SELECT 'no_relations', 0 FROM r WHERE n = 0 UNION ALL SELECT 'low_relation_ratio', round(r.n / s.n, 6) FROM r, s WHERE r.n > 0 AND r.n / s.n < 0.1 "
    "UNION ALL SELECT 'duplicate_entities', CAST(n AS DOUBLE) FROM u WHERE n > 0"
)
def anomalies(spark, sf_dir):
    return Q.anomalies(entities(spark, sf_dir), edges(spark, sf_dir))


_LATENCY = "SELECT event_type, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS spread"


@query(_LATENCY + "".join(f", round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (50, 75, 90, 95, 99)) + " FROM events GROUP BY event_type")
def latency_stats(spark, sf_dir):
    return Q.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


@query(
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) "
    "SELECT event_type, " + ", ".join(f"max(CASE WHEN i = least(n - 1, CAST(floor(n * {p / 100}) AS BIGINT)) THEN value END) AS p{p}" for p in (50, 95, 99)) + " FROM r GROUP BY event_type"
)
def index_percentiles(spark, sf_dir):
    return Q.index_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", (50, 95, 99))


@query(
    "WITH g AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) "
    "SELECT user_id, max(n) AS n, max(CASE WHEN n < 20 AND i = n - 1 OR n >= 20 AND i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) THEN value END) AS p95, "
    "max(CASE WHEN n < 100 AND i = n - 1 OR n >= 100 AND i = least(n - 1, CAST(floor(n * 0.99) AS BIGINT)) THEN value END) AS p99 FROM g GROUP BY user_id"
)
def gated_percentiles(spark, sf_dir):
    """The pipeline's percentiles: the maximum while a group has too few values."""
    out = Q.index_percentiles(table(spark, sf_dir, "events"), ["user_id"], "value", (95, 99), gates=(20, 100))
    return out.select("user_id", "n", "p95", "p99")


@query(
    "SELECT user_id, count(*) AS total, count_if(event_type = 'error') AS failed, round(1 - count_if(event_type = 'error') / count(*), 6) AS success_rate, "
    "round(avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS mean_latency FROM events GROUP BY user_id"
)
def query_metrics(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(bad).alias("failed"), F.round(1 - F.count_if(bad) / F.count("*"), 6).alias("success_rate"), F.round(F.avg(F.when(~bad, F.col("value"))), 6).alias("mean_latency")
    )


@query(
    "SELECT format('events_total{{type=\"{}\"}} {}', event_type, count(*)) AS line FROM events GROUP BY event_type"
)
def metrics_export(spark, sf_dir):
    """Metrics as text lines, one a series."""
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select(F.format_string('events_total{type="%s"} %d', "event_type", "n").alias("line"))


@query(
    "SELECT event_type, user_id, count(*) AS n, min(ts) AS oldest, max(ts) AS newest FROM (SELECT event_type, user_id % 7 AS user_id, ts FROM events) "
    "GROUP BY GROUPING SETS ((event_type), (user_id), ())"
)
def queue_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("user_id"), "ts")
    e, u = F.col("event_type"), F.col("user_id")
    return rows.groupingSets([[e], [u], []], e, u).agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


@query(
    CHUNKS + "SELECT lang, count(*) AS n, min(length(text)) AS low, max(length(text)) AS high, round(avg(length(text)), 6) AS mean, count_if(contains(text, chr(10))) AS multi_line "
    "FROM chunks JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang"
)
def chunk_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    size = F.length("text").cast("long")
    rows = chunks(docs).select("doc_id", size.alias("size"), F.contains("text", F.lit("\n")).alias("multi")).join(docs.select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"), F.round(F.avg("size"), 6).alias("mean"), F.count_if("multi").alias("multi_line"))


@query(
    GRAPH + ", g AS (SELECT a, count(DISTINCT b) AS degree FROM both_ways GROUP BY a), s AS (SELECT avg(degree) AS mean, count(*) AS n, sum(degree) / 2 AS e FROM g) "
    "SELECT a AS hub, degree, round(e / (n * (n - 1) / 2.0), 8) AS density FROM g, s WHERE degree >= greatest(3, 1.5 * mean)"
)
def hubs(spark, sf_dir):
    return Q.hubs(undirected(edges(spark, sf_dir)))


@query(
    "WITH x AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) "
    "SELECT label, CAST(i AS INT) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM x GROUP BY label, i"
)
def community_vectors(spark, sf_dir):
    """The mean vector of each label, one row a dimension."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return rows.groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("SELECT CAST(len(embedding) AS INT) AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def dimension_check(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))


# Windows.


@query(
    "SELECT event_id, event_type, CAST(r AS INT) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5"
)
def key_events(spark, sf_dir):
    """The best of each kind: partial top-k per task first, so the window sees few rows."""
    return Q.top_per_group(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value", "event_id", 5).select("event_id", "event_type", F.col("pick"))


@query(
    "SELECT user_id, event_id, round(value - lag(value) OVER w, 6) AS delta, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS recent "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
)
def progress_deltas(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    out = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("delta"), F.round(F.avg("value").over(w.rowsBetween(-1, 0)), 6).alias("recent"))
    return out


@query(
    CHUNKS + "SELECT doc_id, pos, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM chunks"
)
def chunk_offsets(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks(table(spark, sf_dir, "documents")).select("doc_id", "pos", F.length("text").alias("n"))
    return rows.select("doc_id", "pos", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long").alias("start_offset"))


@query("SELECT o_custkey AS customer, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS latest FROM orders GROUP BY 1")
def latest_version(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query(
    "WITH y AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderdate AS d, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) "
    "SELECT c AS customer, coalesce(count_if(date_diff('day', CAST(p AS DATE), CAST(d AS DATE)) > 180), 0) AS gaps, round(greatest(0.0, 1 - 0.2 * coalesce(count_if(date_diff('day', CAST(p AS DATE), CAST(d AS DATE)) > 180), 0)), 6) AS consistency FROM y GROUP BY c"
)
def temporal_chain(spark, sf_dir):
    """Gaps in each chain of dates, and its consistency."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), (F.datediff("o_orderdate", F.lag("o_orderdate").over(w)) > 180).alias("gap"))
    gaps = F.count_if(F.coalesce("gap", F.lit(False)))
    return rows.groupBy("customer").agg(gaps.alias("gaps"), F.round(F.greatest(F.lit(0.0), 1 - 0.2 * gaps), 6).alias("consistency"))


@query(
    "WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS score, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS r FROM d) "
    "SELECT round(avg(score), 6) AS mean_score, CAST(sum(n) AS BIGINT) AS total, arg_max(score, day) > arg_min(score, day) AS improving FROM r WHERE r <= 10"
)
def score_trend(spark, sf_dir):
    """The last ten days' mean, and whether it went up; days are ranked after the aggregation."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("score"), F.count("*").alias("n")).orderBy(F.desc("day")).limit(10)
    return days.agg(F.round(F.avg("score"), 6).alias("mean_score"), F.sum("n").alias("total"), (F.max_by("score", "day") > F.min_by("score", "day")).alias("improving"))
