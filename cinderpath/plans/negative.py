"""Queries of negative evidence: what orders tell about their customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contradiction as C
from ..session import table
from .registry import query

#: An order's text, in SQL that both engines read: confirmed, denied, changed, plain, or denied in Korean.
_TEXT = (
    "CASE WHEN o_orderstatus = 'F' THEN concat('Order ', o_orderkey, ' was confirmed and clearly delivered in ', o_orderkey % 40, ' days for ', CAST(o_totalprice AS BIGINT), ' dollars') "
    "WHEN o_orderkey % 4 = 0 THEN concat('The order was not ever delivered, however it was never paid: ', o_orderkey % 9, ' Days') "
    "WHEN o_orderkey % 4 = 1 THEN concat('It formerly took ', o_orderkey % 30, ' days, ', o_orderkey % 7, ' days at best') "
    "WHEN o_orderkey % 4 = 2 THEN concat('주문 없다 ', CAST(o_totalprice AS BIGINT), ' dollars') ELSE concat('Paid ', CAST(o_totalprice AS BIGINT) // 1000, ' dollars') END"
)
#: DuckDB's cast rounds, halves to even; Spark's cuts off.
_SPARK_TEXT = _TEXT.replace("CAST(o_totalprice AS BIGINT) // 1000", "CAST(floor(CAST(o_totalprice AS BIGINT) / 1000) AS BIGINT)").replace("CAST(o_totalprice AS BIGINT)", "CAST(rint(o_totalprice) AS BIGINT)")
#: The same told by its kind: polarity, change, Korean negation; and its numbers by unit.
_TOLD = (
    f"WITH e AS MATERIALIZED (SELECT o_custkey AS grp, o_orderkey AS id, o_orderkey % 100 / 100.0 AS score, {_TEXT} AS text, "
    "CASE WHEN o_orderstatus = 'F' THEN 'POSITIVE' WHEN o_orderkey % 4 = 0 THEN 'NEGATIVE' WHEN o_orderkey % 4 = 1 THEN 'NEUTRAL' WHEN o_orderkey % 4 = 2 THEN 'UNCERTAIN' ELSE 'NEUTRAL' END AS pol, "
    "o_orderstatus <> 'F' AND o_orderkey % 4 = 1 AS change, o_orderstatus <> 'F' AND o_orderkey % 4 = 2 AS korean FROM orders), "
    "v AS MATERIALIZED (SELECT grp, id, unnest(regexp_extract_all(text, '(\\d+) ([dD]ay|dollar)s', 1)) AS n, lower(unnest(regexp_extract_all(text, '(\\d+) ([dD]ay|dollar)s', 2))) AS u FROM e), "
    "c AS (SELECT DISTINCT x.grp, x.id, y.id AS other FROM v x JOIN v y ON x.grp = y.grp AND x.u = y.u AND x.id <> y.id AND CAST(x.n AS DOUBLE) <> 0 AND abs(CAST(x.n AS DOUBLE) - CAST(y.n AS DOUBLE)) / CAST(x.n AS DOUBLE) > 0.2), "
    "pairs AS (SELECT x.grp, x.id, CASE WHEN (x.pol = 'POSITIVE' AND y.pol = 'NEGATIVE') OR (x.pol = 'NEGATIVE' AND y.pol = 'POSITIVE') THEN 1 WHEN c.other IS NOT NULL THEN 2 WHEN x.change <> y.change OR x.korean <> y.korean THEN 3 ELSE 0 END AS k "
    "FROM e x JOIN e y ON x.grp = y.grp AND x.id <> y.id LEFT JOIN c ON c.grp = x.grp AND c.id = x.id AND c.other = y.id), "
    "s AS (SELECT e.grp, e.id, any_value(pol) AS pol, any_value(score) AS score, count(*) FILTER (k = 1) AS n_opposite, count(*) FILTER (k = 2) AS n_value, count(*) FILTER (k = 3) AS n_change FROM e LEFT JOIN pairs USING (grp, id) GROUP BY e.grp, e.id) "
)


def _evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey AS grp", "o_orderkey AS id", "o_orderkey % 100 / 100.0D AS score", f"{_SPARK_TEXT} AS text")
    return rows.withColumn("query", F.lit("was it ever delivered"))


@query(_TOLD + "SELECT grp, id, n_opposite, n_value, n_change, round((n_opposite * 0.6 + n_value * 0.7 + n_change * 0.5) * 0.1, 6) AS penalty FROM s")
def evidence_contradictions(spark, sf_dir):
    """How many of a customer's other orders contradict what is told of each."""
    return C.contradictions(_evidence(spark, sf_dir)).withColumn("penalty", F.round("penalty", 6))


@query(
    _TOLD + "SELECT grp, id, pol AS polarity, CASE pol WHEN 'POSITIVE' THEN 0.8 WHEN 'NEGATIVE' THEN 0.95 WHEN 'NEUTRAL' THEN 0.7 ELSE 0.5 END AS polarity_confidence, "
    "round(greatest(0.0, score * CASE pol WHEN 'NEGATIVE' THEN 0.85 WHEN 'UNCERTAIN' THEN 0.95 ELSE 1.0 END * (1 - least(0.3, (n_opposite * 0.6 + n_value * 0.7 + n_change * 0.5) * 0.1))), 6) AS adjusted, pol <> 'NEGATIVE' AS supports FROM s"
)
def adjusted_scores(spark, sf_dir):
    return C.adjusted(_evidence(spark, sf_dir)).select("grp", "id", "polarity", F.round("polarity_confidence", 6).alias("polarity_confidence"), F.round("adjusted", 6).alias("adjusted"), "supports")


#: Where words of negation begin, by scanning a text word by word; and the clause that follows.
@query(
    "WITH t AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '(?i)\\b(?:not|no|never|none|without|lack|cannot)\\b')) AS w, unnest(range(1, len(regexp_extract_all(text, '(?i)\\b(?:not|no|never|none|without|lack|cannot)\\b')) + 1)) AS i, "
    "regexp_split_to_array(text, '(?i)\\b(?:not|no|never|none|without|lack|cannot)\\b') AS parts FROM documents), "
    "p AS (SELECT doc_id, text, w, length(array_to_string(parts[1:i], '')) + list_sum(list_transform(regexp_extract_all(text, '(?i)\\b(?:not|no|never|none|without|lack|cannot)\\b')[1:i], lambda x: length(x))) - length(w) AS s FROM t) "
    "SELECT doc_id AS id, CAST(s AS INT) AS start, lower(w) AS word, CAST(s + length(w) + length(regexp_extract(substr(text, CAST(s + length(w) + 1 AS BIGINT)), '(?is)^(.*?)(?:[.!?,;:]|but|however|although|\\z)', 1)) AS INT) AS scope_end FROM p "
    "WHERE NOT regexp_matches(CASE WHEN s > 0 THEN substr(text, CAST(s AS BIGINT), 1) ELSE '' END || substr(text, CAST(s + length(w) + 1 AS BIGINT), 1), '[\\pL\\pN_]')"
)
def negation_scopes(spark, sf_dir):
    """Negations of the commonest words in all documents, and where their scopes end."""
    spans = C.negations(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return spans.where(F.col("word").isin("not", "no", "never", "none", "without", "lack", "cannot")).select("id", "start", "word", "scope_end")
