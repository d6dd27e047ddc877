"""Evidence queries: sentences made of orders, scored against a few questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as E
from ..operators.quality import top_per_group
from ..session import table
from .registry import query

#: A sentence an order, in SQL that Spark and DuckDB both read but for the date's format.
_TEXT = (
    "concat(CASE o_orderkey % 3 WHEN 0 THEN 'Acme Corp established order ' WHEN 1 THEN 'Globex created order ' ELSE 'The clerk saw order ' END, o_orderkey, ' on ', {day}, "
    "CASE o_orderstatus WHEN 'F' THEN ', which was confirmed and verified as correct' WHEN 'O' THEN ', but it did not ship and was never sent' ELSE ', which it no longer needs' END, '.')"
)
QUESTIONS = ("When was Acme Corp established?", "Did Globex ship in 1997?", "Who saw the clerk before 1995 or 1996?")

_Q = ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS))
SENTENCES = f"WITH s AS (SELECT o_orderkey AS id, {_TEXT.format(day="strftime(o_orderdate, '%Y-%m-%d')")} AS text FROM orders), q(q, question) AS (VALUES {_Q}), p AS (SELECT id, text, q, question FROM s, q) "
_VERB_LIST = "[" + ", ".join(f"'{v}'" for v in E.VERBS) + "]"


def _ents(x: str) -> str:
    return (
        f"list_distinct(list_transform(list_concat(list_filter(regexp_extract_all({x}, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1), lambda m: length(m) > 2), "
        f"regexp_extract_all({x}, '\\b(\\d{{4}}|\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}|\\w+\\s+\\d{{1,2}},?\\s+\\d{{4}})\\b', 1)), lambda m: lower(m)))"
    )


def _years(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '\\b(1[89]\\d{{2}}|20[0-9]{{2}})\\b', 1), lambda y: CAST(y AS INT))"


def _hits(words: str) -> str:
    return f"len(regexp_extract_all(lower(text), '\\b({words.replace(chr(39), chr(39) * 2)})\\b', 1))"


_PARTS = (
    SENTENCES + f", e AS (SELECT *, {_ents('question')} AS qe, {_ents('text')} AS te, {_years('question')} AS qy, {_years('text')} AS ty, {_hits(E.NEGATIONS)} AS n_no, {_hits(E.CONTRASTS)} AS n_but, {_hits(E.CONFIRMATIONS)} AS n_yes, "
    f"list_filter({_VERB_LIST}, lambda v: contains(lower(question), v)) AS qv, list_filter({_VERB_LIST}, lambda v: contains(lower(text), v)) AS tv FROM p), "
    "m AS (SELECT *, list_min(qy) AS q0, list_max(qy) AS q1, list_min(ty) AS t0, list_max(ty) AS t1 FROM e), "
    "f AS (SELECT id, q, CASE WHEN len(qe) = 0 OR len(te) = 0 THEN 0.0 ELSE len(list_intersect(qe, te)) / CAST(len(list_distinct(list_concat(qe, te))) AS DOUBLE) END AS overlap, "
    "CAST(CASE WHEN len(qv) = 0 THEN 0.5 WHEN len(list_intersect(qv, tv)) > 0 THEN 1.0 WHEN len(tv) > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS relation, "
    "CAST(CASE WHEN len(qy) = 0 THEN 0.5 WHEN len(ty) = 0 THEN 0.4 WHEN q0 = t0 AND q1 = t1 THEN 1.0 "
    "WHEN q0 <= t1 AND q1 >= t0 THEN 0.6 + 0.4 * (least(q1, t1) - greatest(q0, t0) + 1) / CAST(greatest(q1, t1) - least(q0, t0) + 1 AS DOUBLE) "
    "WHEN least(abs(q0 - t1), abs(q1 - t0)) <= 5 THEN 0.5 + 0.2 * (5 - least(abs(q0 - t1), abs(q1 - t0))) / 5.0 ELSE greatest(0.1, 0.4 - least(abs(q0 - t1), abs(q1 - t0)) / 50.0) END AS DOUBLE) AS temporal, "
    "CASE WHEN n_no + n_but > n_yes + 1 THEN 'NEGATIVE' WHEN n_yes > n_no + n_but + 1 THEN 'POSITIVE' WHEN n_no = 0 AND n_yes = 0 THEN 'NEUTRAL' ELSE 'UNCERTAIN' END AS polarity FROM m), "
    "g AS (SELECT *, overlap * 0.35 + relation * 0.25 + temporal * 0.2 + CAST(CASE polarity WHEN 'NEGATIVE' THEN 0.07 WHEN 'UNCERTAIN' THEN 0.09 ELSE 0.1 END AS DOUBLE) AS score FROM f) "
)


def _told(spark, sf_dir):
    """(id, text) of every order with what its text tells, once for all questions."""
    text = _TEXT.format(day="date_format(o_orderdate, 'yyyy-MM-dd')")
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{text} AS text")
    t = F.col("text")
    return rows.select("id", E.entities(t).alias("entities"), E.verbs(t).alias("verbs"), E.years(t).alias("years"), E.polarity(t).alias("polarity"))


def _scored(spark, sf_dir):
    """Every order with each of the questions, which are literals in the plan, as is what they ask for."""
    asked = lambda i, q: F.struct(F.lit(i).alias("q"), E.entities(q).alias("entities"), E.verbs(q).alias("verbs"), E.years(q).alias("years"))
    rows = _told(spark, sf_dir).withColumn("a", F.explode(F.array(*(asked(i, F.lit(q)) for i, q in enumerate(QUESTIONS)))))
    parts = rows.select("id", "a.q", E.overlap(F.col("a.entities"), F.col("entities")).alias("overlap"), E.verb_match(F.col("a.verbs"), F.col("verbs")).alias("relation"), E.ranges_alignment(F.col("a.years"), F.col("years")).alias("temporal"), "polarity")
    score = E.grounded_score(F.col("overlap"), F.col("relation"), F.col("temporal"), F.lit(0.0), F.col("polarity"))
    return parts.withColumn("score", score)


@query(_PARTS + "SELECT id, q, round(overlap, 6) AS overlap, relation, round(temporal, 6) AS temporal, polarity, round(score, 6) AS score FROM g")
def evidence_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "q", F.round("overlap", 6).alias("overlap"), "relation", F.round("temporal", 6).alias("temporal"), "polarity", F.round("score", 6).alias("score"))


@query(_PARTS + ", r AS (SELECT q, id, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, id) AS pick FROM g) SELECT q, id, score, CAST(pick AS INT) AS pick FROM r WHERE pick <= 30")
def ranked_evidence(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("q", "id", F.round("score", 6).alias("score"))
    return top_per_group(rows, ["q"], "score", "id", 30)


@query(
    _PARTS + "SELECT q, CASE WHEN overlap >= 0.3 AND relation >= 0.8 THEN 'EXPLICIT' WHEN overlap >= 0.1 OR relation >= 0.5 THEN 'IMPLICIT' ELSE 'INFERRED' END AS kind, "
    "CASE WHEN score > 0.8 THEN 'confident' WHEN score > 0.6 THEN 'probable' WHEN score > 0.4 THEN 'uncertain' ELSE 'insufficient' END AS answer, count(*) AS n FROM g GROUP BY ALL"
)
def evidence_classes(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return rows.groupBy("q", E.evidence_class(F.col("overlap"), F.col("relation")).alias("kind"), E.answer_class(F.col("score")).alias("answer")).agg(F.count("*").alias("n"))


@query(
    _PARTS + "SELECT q, max(CASE WHEN overlap >= 0.3 AND relation >= 0.8 THEN 1 ELSE 0 END) = 0 AS no_explicit, bool_and(overlap < 0.2) AS weak_entities, bool_and(relation < 0.5) AS weak_relations, "
    "bool_and(temporal < 0.5) AS weak_times FROM g GROUP BY q"
)
def evidence_gaps(spark, sf_dir):
    explicit = E.evidence_class(F.col("overlap"), F.col("relation")) == "EXPLICIT"
    return _scored(spark, sf_dir).groupBy("q").agg(
        (~F.bool_or(explicit)).alias("no_explicit"), F.bool_and(F.col("overlap") < 0.2).alias("weak_entities"), F.bool_and(F.col("relation") < 0.5).alias("weak_relations"), F.bool_and(F.col("temporal") < 0.5).alias("weak_times")
    )
