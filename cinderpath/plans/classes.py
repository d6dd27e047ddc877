"""Queries that classify questions and texts; questions are made of parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..session import table
from .registry import query

QUESTIONS = (
    "Hello!", "help", "What's up?", "안녕하세요", "너는 누구야?", "how's it going?", "What is machine learning?", "What is the capital of France?", "How do I reset it?", "Why does it rain?", "List all types of bolts",
    "Explain in detail how it works", "What do you think of it? Explain the view", "Is it both red and blue?", "Can it fly?", "Compare Red Bolt versus Blue Nut", "Who also worked with Marie Curie?", "connection of Globex to Acme",
    "count the orders", "Who founded Acme Corp?", "보안 취약점이란 무엇인가?", "왜 그런가?", "the bank loan and bond market in court", "a software server for the database network system", "Did Paul Erdos visit \"Black Forest\" through IBM and AWS in 2020-03-04?",
    "Where is Stanford University? It has 20 GB of Python and Rust, FY2021", "research paper on disease and treatment of a patient", "",
)
_LIST = "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS) + "]"
_Q = f"WITH qs AS (SELECT p_partkey AS id, concat({_LIST}[1 + p_partkey % {len(QUESTIONS)}], CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(' ', p_name) END) AS q FROM part) "


def _questions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    base = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("p_partkey") % len(QUESTIONS) + 1).cast("int"))
    return part.select(F.col("p_partkey").alias("id"), F.concat(base, F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "p_name"))).alias("q"))


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {_s(p)})" for p in patterns) + ")"


def _has(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {_s(p)})" for p in parts) + ")"


def _hits(x: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {_s(w.lower())}) AS INT)" for w in words) + ")"


_SCORED = ", ".join(f"({i}, {_s(n)}, {max(len(w) * 0.3, 1.0)!r})" for i, (n, w) in enumerate(C.DOMAINS.items()))
_INTENT = "CASE " + " ".join(f"WHEN {_any('lower(trim(q))', p)} THEN '{n}'" for n, p in C.INTENTS.items()) + " ELSE 'KNOWLEDGE' END"
_TYPE = (
    f"CASE WHEN {_any('l', C.DEFINITION)} AND NOT {_has('l', C.FACTS)} THEN 'definition' WHEN {_any('l', C.PROCEDURE)} THEN 'procedure' WHEN {_any('l', C.CAUSE)} THEN 'cause_effect' WHEN {_any('l', C.LIST)} THEN 'list' "
    f"WHEN {_any('l', C.NARRATIVE)} THEN CASE WHEN {_has('l', C.OPINIONS)} THEN 'opinion' ELSE 'narrative' END WHEN {_has('l', C.YESNO)} THEN CASE WHEN {_has('l', C.BOTH)} THEN 'comparison' ELSE 'yesno' END "
    f"WHEN {_has('l', C.COMPARISON)} THEN 'comparison' WHEN {_has('l', C.MULTIHOP)} THEN 'multihop' WHEN {_has('l', C.BRIDGE)} THEN 'bridge' WHEN {_has('l', C.AGGREGATION)} THEN 'aggregation' ELSE 'factoid' END"
)


@query(
    _Q + f", k(i, domain, base) AS (VALUES {_SCORED}), h AS (SELECT id, unnest([{', '.join(_hits('lower(q)', w) for w in C.DOMAINS.values())}]) AS n, generate_subscripts([0, 0, 0, 0, 0, 0], 1) - 1 AS i FROM qs), "
    "b AS (SELECT id, max(n) AS n, arg_max(i, n * 10 - i) AS i FROM h GROUP BY id) SELECT id, CASE WHEN n < 2 THEN 'general' ELSE domain END AS domain, round(CASE WHEN n < 2 THEN 0.0 ELSE least(1.0, n / base) END::DOUBLE, 6) AS confidence FROM b JOIN k USING (i)"
)
def question_domains(spark, sf_dir):
    rows = _questions(spark, sf_dir).select("id", C.domain(F.col("q")).alias("d"))
    return rows.select("id", "d.domain", F.round("d.confidence", 6).alias("confidence"))


@query(_Q + f"SELECT id, {_INTENT} AS intent, {_TYPE} AS kind FROM (SELECT id, q, lower(q) AS l FROM qs)")
def question_types(spark, sf_dir):
    return _questions(spark, sf_dir).select("id", C.intent(F.col("q")).alias("intent"), C.question_type(F.col("q")).alias("kind"))


_MENTIONS = f"list_concat(regexp_extract_all(q, '\"([^\"]+)\"', 1), regexp_extract_all(q, '''([^'']+)''', 1), list_filter(regexp_extract_all(q, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{0,3}})\\b', 1), lambda x: NOT list_contains([{', '.join(map(_s, C.STARTERS))}], x)))"


@query(
    _Q + f", c AS (SELECT id, q, list_distinct(list_concat(regexp_extract_all(q, '\\b[A-Z][a-zA-Z]+\\b'), list_transform(regexp_extract_all(q, '([가-힣]+)[은는이가을를]', 1), lambda x: x), regexp_extract_all(q, '[\"'']([^\"'']+)[\"'']', 1), regexp_extract_all(q, '\\b[A-Z]{{2,}}(?:-\\d+)*\\b'))) AS c FROM qs), "
    f"n AS (SELECT id, q, CASE WHEN len(c) <= 1 THEN 0 WHEN len(c) <= 3 THEN 1 WHEN len(c) <= 5 THEN 2 ELSE 3 END + CASE WHEN {_hits('lower(q)', C.LINKING)} >= 2 THEN 1 ELSE 0 END AS level FROM c) "
    f"SELECT id, ['simple', 'moderate', 'complex', 'multi_hop'][1 + least(level, 3)] AS complexity, array_to_string(list_sort(list_distinct({_MENTIONS})), '|') AS mentions FROM n"
)
def question_complexity(spark, sf_dir):
    q = F.col("q")
    return _questions(spark, sf_dir).select("id", C.complexity(q).alias("complexity"), F.array_join(F.array_sort(C.mentions(q)), "|").alias("mentions"))


@query(
    _Q + ", m AS (" + " UNION ALL ".join(f"SELECT id, {i} AS p, '{kind}' AS kind, unnest(regexp_extract_all(q, {_s(p)})) AS text, generate_subscripts(regexp_extract_all(q, {_s(p)}), 1) AS j FROM qs" for i, (kind, p) in enumerate(C.NAMED))
    + ") SELECT id, arg_min(kind, p * 1000 + j) AS kind, arg_min(trim(text), p * 1000 + j) AS text FROM m GROUP BY id, lower(trim(text))"
)
def named_patterns(spark, sf_dir):
    return _questions(spark, sf_dir).select("id", F.explode(C.named(F.col("q"))).alias("n")).select("id", "n.kind", "n.text")


_PHRASES = "regexp_extract_all(q, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1)"
_DATES = "regexp_extract_all(q, '\\b(\\d{4}|\\w+\\s+\\d{1,2},?\\s+\\d{4})\\b', 1)"


@query(
    _Q + f", e AS (SELECT id, q, len(list_concat(list_filter({_PHRASES}, lambda m: length(m) > 2), regexp_extract_all(q, '\"([^\"]+)\"', 1), regexp_extract_all(q, '\\b(\\d{{4}}|\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}|\\w+\\s+\\d{{1,2}},?\\s+\\d{{4}})\\b', 1), regexp_extract_all(q, '([가-힣]{{2,}})', 1))) AS n, "
    f"regexp_extract_all(q, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b', 1) AS p, {_PHRASES} AS l, {_DATES} AS d FROM qs) "
    "SELECT id, CASE WHEN n > 0 AND len(p) > 0 THEN p[1] END AS person, CASE WHEN n = 0 THEN 0.0 WHEN len(l) > 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS location, CASE WHEN n > 0 AND len(d) > 0 THEN d[1] END AS date FROM e"
)
def answer_candidates(spark, sf_dir):
    rows = _questions(spark, sf_dir).select("id", *(C.answer(F.col("q"), k).alias(k) for k in ("person", "location", "date")))
    exact = lambda k: F.when(F.col(k)["score"] == 1.0, F.col(k)["answer"]).alias(k)
    return rows.select("id", exact("person"), F.col("location")["score"].alias("location"), exact("date"))
