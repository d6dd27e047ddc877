"""Queries over evidence lists and reasoning chains; the evidence is made of events, a chain for each user."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reasoning as R
from ..session import table
from .registry import query

_KIND = "CASE event_type WHEN 'click' THEN 'DIRECT' WHEN 'view' THEN 'INFERRED' WHEN 'purchase' THEN 'PATH' WHEN 'signup' THEN 'CONTEXTUAL' ELSE 'COMMUNITY' END"
_COLUMNS = ("event_id AS id", "user_id AS chain", f"{_KIND} AS kind", "CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS score", "CAST(event_id % 4 AS INT) AS hop", "event_id % 3 = 0 AS explicit", "event_type = 'view' AS fuzzy")
_EVIDENCE = f"WITH ev AS (SELECT {', '.join(_COLUMNS)} FROM events) "
_PRIORITY = ("DIRECT", "INFERRED", "PATH", "CONTEXTUAL", "COMMUNITY")


def _evidence(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*_COLUMNS)


@query(
    _EVIDENCE + ", l AS (SELECT id % 500 AS id, score, kind, 0 AS list, id AS own FROM ev WHERE kind = 'DIRECT' UNION ALL SELECT id % 500, score / 2, kind, 1, id FROM ev WHERE kind = 'PATH'), "
    "f AS (SELECT id, arg_min(score, struct_pack(l := list, o := own)) AS score, arg_min(kind, struct_pack(l := list, o := own)) AS kind FROM l GROUP BY id) SELECT id, kind, score FROM f ORDER BY score DESC, id LIMIT 30"
)
def merged_evidence(spark, sf_dir):
    ev = _evidence(spark, sf_dir)
    first = lambda kind: ev.where(F.col("kind") == kind).groupBy((F.col("id") % 500).alias("id")).agg(F.min_by(F.struct("kind", "score"), "id").alias("e")).select("id", "e.kind", "e.score")
    return R.merge_lists([first("DIRECT"), first("PATH").withColumn("score", F.col("score") / 2)]).select("id", "kind", "score")


@query(
    _EVIDENCE + ", r AS (SELECT *, row_number() OVER (PARTITION BY chain, hop ORDER BY score DESC, id) AS pick FROM ev) "
    "SELECT chain, hop, id, CAST(pick AS INT) AS pick, CASE WHEN score >= 0.7 THEN 'primary' ELSE 'supporting' END AS role FROM r WHERE pick <= 3"
)
def evidence_provenance(spark, sf_dir):
    return R.provenance(_evidence(spark, sf_dir), ["chain", "hop"]).select("chain", "hop", "id", "pick", "role")


@query(
    _EVIDENCE + ", r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS turn, list_position(['DIRECT', 'INFERRED', 'PATH', 'CONTEXTUAL', 'COMMUNITY'], kind) AS p FROM ev) "
    "SELECT id, kind, CAST(row_number() OVER (ORDER BY turn, p) AS INT) AS place FROM r ORDER BY turn, p LIMIT 12"
)
def key_evidence(spark, sf_dir):
    priority = F.array_position(F.array(*map(F.lit, _PRIORITY)), F.col("kind"))
    return R.round_robin(_evidence(spark, sf_dir), "kind", priority, 12).select("id", "kind", "place")


@query(
    _EVIDENCE + "SELECT chain, hop, CASE WHEN max(score) < 0.3 OR bool_and(fuzzy) AND max(score) < 0.5 THEN 'NO_DATA' ELSE 'OK' END AS verdict FROM ev WHERE score < 0.55 GROUP BY chain, hop"
)
def evidence_gates(spark, sf_dir):
    return R.gate(_evidence(spark, sf_dir).where("score < 0.55"), ["chain", "hop"], "fuzzy")


@query(
    _EVIDENCE + ", r AS (SELECT *, row_number() OVER (PARTITION BY chain, hop ORDER BY score DESC, id) AS r FROM ev), "
    "e AS (SELECT chain, hop, count(*) AS n, least(count(*) / 10.0, 1.0) AS coverage, avg(CASE WHEN r <= 5 THEN score END) AS convergence, CASE WHEN hop > 1 THEN 1.0 ELSE 0.5 END AS done FROM r GROUP BY chain, hop) "
    "SELECT chain, hop, n, round(CAST(coverage AS DOUBLE), 6) AS coverage, round(convergence, 6) AS convergence, round((done + coverage + 0.8 + convergence) / 4, 6) AS sufficiency, "
    "CASE WHEN (done + coverage + 0.8 + convergence) / 4 >= 0.8 THEN 'FINALIZE' WHEN coverage < 0.5 THEN 'RETRIEVE_MORE' WHEN done < 0.8 THEN 'CONTINUE_CHAIN' ELSE 'RE_RANK_EVIDENCE' END AS action FROM e"
)
def evidence_evaluation(spark, sf_dir):
    return R.evaluation(_evidence(spark, sf_dir), ["chain", "hop"], F.when(F.col("hop") > 1, 1.0).otherwise(0.5))


_QUALITY = (
    _EVIDENCE + ", q AS (SELECT chain, count(*) AS n, avg(CASE WHEN kind = 'DIRECT' THEN 1.0 ELSE 0.0 END) AS direct, avg(CASE WHEN kind = 'PATH' THEN 1.0 ELSE 0.0 END) AS path, avg(score) AS relevance, "
    "count(DISTINCT CASE WHEN kind = 'PATH' THEN hop END) AS hops, max(CASE WHEN kind = 'PATH' THEN hop END) AS farthest FROM ev GROUP BY chain), "
    "c AS (SELECT *, chain % 2 = 0 AS connected, chain % 3 AS bridges, chain % 5 AS longest, CASE WHEN coalesce(farthest, 0) > 0 THEN hops / CAST(farthest + 1 AS DOUBLE) ELSE 0.0 END AS covered FROM q), "
    "p AS (SELECT *, least(1.0, greatest(0.0, 0.25 * path + 0.2 * CASE WHEN connected THEN 1.0 ELSE 0.5 END + 0.2 * CASE WHEN bridges = 0 THEN 0.3 ELSE 1.0 END + 0.15 * least(1.0, longest / 3.0) + 0.2 * covered)) AS complete FROM c) "
)


def _quality(spark, sf_dir):
    return R.chain_quality(_evidence(spark, sf_dir), ["chain"])


def _complete(rows):
    return R.path_completeness(rows, F.col("chain") % 2 == 0, F.col("chain") % 3, F.col("chain") % 5)


@query(_QUALITY + "SELECT chain, round(complete, 6) AS completeness FROM p")
def path_completeness(spark, sf_dir):
    rows = _quality(spark, sf_dir)
    return rows.select("chain", F.round(_complete(rows), 6).alias("completeness"))


@query(
    _QUALITY + "SELECT chain, round(greatest(0.0, least(1.0, 0.6 * 0.5 + direct * 0.2 + relevance * 0.2 + 0.75 * 0.1)), 6) AS simple, "
    "round(greatest(0.0, least(CASE WHEN path = 0 THEN 0.65 ELSE 1.0 END, 0.6 * 0.35 + (path * 0.6 + direct * 0.4) * 0.15 + relevance * 0.15 + complete * 0.15 + CASE WHEN path = 0 THEN 1.0 WHEN farthest > 0 THEN covered ELSE 0.5 END * 0.1 "
    "+ 0.75 * 0.05 + (CASE WHEN connected THEN 1.05 ELSE 0.8 END - 1.0) * 0.05)), 6) AS multi_hop FROM p"
)
def answer_confidence(spark, sf_dir):
    rows = _quality(spark, sf_dir)
    base, progress, subgraph = F.lit(0.6), F.lit(0.75), F.when(F.col("chain") % 2 == 0, 1.05).otherwise(0.8)
    return rows.select("chain", F.round(R.final_confidence(base, progress, False), 6).alias("simple"), F.round(R.final_confidence(base, progress, True, _complete(rows), subgraph), 6).alias("multi_hop"))


_STEPS = ", st AS (SELECT user_id AS chain, event_id AS step, event_id + CASE WHEN event_id % 50 = 0 THEN 1000000000 ELSE 0 END AS evidence, event_id % 977 AS query FROM events) "


def _steps(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id AS chain", "event_id AS step", "event_id + CASE WHEN event_id % 50 = 0 THEN 1000000000 ELSE 0 END AS evidence", "event_id % 977 AS query")


@query(_EVIDENCE + _STEPS + "SELECT chain, string_agg(CAST(evidence AS VARCHAR), ',' ORDER BY step) AS evidence FROM st GROUP BY chain")
def chain_evidence(spark, sf_dir):
    return R.chain_members(_steps(spark, sf_dir))


@query(
    _EVIDENCE + _STEPS + ", m AS (SELECT s.chain, count(*) AS steps, count_if(ev.id IS NULL) AS missing FROM (SELECT st.chain, st.evidence FROM st) s LEFT JOIN ev ON ev.id = s.evidence GROUP BY s.chain), "
    "d AS (SELECT chain, count(*) AS repeated FROM (SELECT chain, query FROM st GROUP BY ALL HAVING count(*) > 1) GROUP BY chain) "
    "SELECT m.chain, steps, missing, coalesce(repeated, 0) AS repeated, CASE WHEN coalesce(repeated, 0) > 0 THEN 'INVALID' WHEN missing = 0 THEN 'VALID' WHEN (steps - missing) * 2 >= steps THEN 'PARTIAL' ELSE 'INVALID' END AS status FROM m LEFT JOIN d ON d.chain = m.chain"
)
def chain_validation(spark, sf_dir):
    return R.chain_status(_steps(spark, sf_dir), _evidence(spark, sf_dir))


@query(
    _EVIDENCE + ", a AS (SELECT chain, avg(CASE WHEN explicit THEN 1.0 ELSE 0.0 END) AS share, ['GRAPH_ONLY', 'GRAPH_PRIMARY', 'LLM_SUPPLEMENTED', 'LLM_ONLY', 'UNKNOWN'][1 + chain % 5] AS source FROM ev WHERE id % 7 < 3 GROUP BY chain) "
    "SELECT chain, source, CASE source WHEN 'GRAPH_ONLY' THEN 1.0 WHEN 'GRAPH_PRIMARY' THEN 0.95 WHEN 'LLM_SUPPLEMENTED' THEN 0.85 WHEN 'LLM_ONLY' THEN 0.7 ELSE 0.8 END::DOUBLE AS multiplier, "
    "CASE WHEN source IN ('GRAPH_ONLY', 'GRAPH_PRIMARY') THEN CASE WHEN share < 0.2 THEN 'MEDIUM' ELSE 'LOW' END WHEN source = 'LLM_SUPPLEMENTED' THEN CASE WHEN share >= 0.5 THEN 'LOW' ELSE 'MEDIUM' END ELSE 'HIGH' END AS risk FROM a"
)
def answer_risks(spark, sf_dir):
    source = F.element_at(F.array(*map(F.lit, ("GRAPH_ONLY", "GRAPH_PRIMARY", "LLM_SUPPLEMENTED", "LLM_ONLY", "UNKNOWN"))), (F.col("chain") % 5 + 1).cast("int"))
    rows = _evidence(spark, sf_dir).where("id % 7 < 3").groupBy("chain").agg(F.avg(F.col("explicit").cast("double")).alias("share")).withColumn("source", source)
    return rows.select("chain", "source", R.source_multiplier(F.col("source")).alias("multiplier"), R.hallucination_risk(F.col("source"), F.col("share")).alias("risk"))


@query(
    "WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d0, CAST(o_orderdate AS DATE) + 90 AS d1, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) "
    "SELECT k AS id, d0 <= n + 90 AND n <= d1 AS meets, round(abs(date_diff('day', n, d0)) / 365.25, 6) AS years FROM o WHERE n IS NOT NULL"
)
def interval_distances(spark, sf_dir):
    """Each order's ninety days against those of its customer's next order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"), F.lead(F.to_date("o_orderdate")).over(w).alias("n")).where("n is not null")
    return rows.select("id", R.intervals_meet(F.col("d"), F.date_add("d", 90), F.col("n"), F.date_add("n", 90)).alias("meets"), F.round(R.years_between(F.col("n"), F.col("d")), 6).alias("years"))


@query(_EVIDENCE + "SELECT id, round(score * greatest(0.5, 1 - 0.1 * (hop + 1 - 1)), 6) AS relevance, least(2.0 * pow(2.0, hop + user_hops), 60.0) AS wait FROM (SELECT *, chain % 6 AS user_hops FROM ev)")
def path_relevances(spark, sf_dir):
    ev = _evidence(spark, sf_dir)
    return ev.select("id", F.round(R.path_relevance(F.col("score"), F.col("hop") + 1), 6).alias("relevance"), R.backoff(F.lit(2.0), F.col("hop") + F.col("chain") % 6, F.lit(60.0)).alias("wait"))
