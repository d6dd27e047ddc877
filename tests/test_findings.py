"""Queries on small tables made for what once went wrong, against their SQL, and plans that must not bring a table to one task."""

import duckdb
import pytest

from cinderpath import plans
from cinderpath.operators import ontology


def _both_ways(spark, tmp_path, name, **tables):
    """The rows of a query and of its SQL on tables given as (schema, rows)."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, plans.QUERIES[name](spark, str(tmp_path)).collect()))
    return got, sorted(con.execute(plans.ORACLE_SQL[name]).fetchall())


def test_changed_relations_takes_unknown_parts_last(spark, tmp_path):
    rows = [(7, 1, None, 5.0, 0.1), (7, 2, None, 5.0, 0.1), (7, 2, 3, 6.0, 0.2), (5, 1, None, 1.0, 0.3), (22, 1, None, 1.0, 0.3), (3, 1, 4, 1.0, 0.1), (3, 1, 4, 2.0, 0.2)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_tax double"
    got, want = _both_ways(spark, tmp_path, "changed_relations", lineitem=(schema, rows))
    assert got == want and (7, 1, "MODIFIED") in got and (3, 1, "UNCHANGED") in got


def test_evidence_contradictions_rounds_prices_as_its_sql(spark, tmp_path):
    rows = [(40, 1, "F", 100.0), (80, 1, "F", 120.6), (120, 1, "F", 119.5), (160, 1, "F", 120.5), (43, 1, "O", 9999.7), (47, 1, "O", 8400.2)]
    got, want = _both_ways(spark, tmp_path, "evidence_contradictions", orders=("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double", rows))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [float(r[5]) for r in got] == pytest.approx([float(r[5]) for r in want])


def test_cardinality_violations_is_not_dealt_by_type_alone(spark):
    edges = spark.createDataFrame([("a", "p", "MAKES"), ("b", "p", "MAKES"), ("a", "q", "MAKES")], "src string, dst string, rel_type string")
    rules = spark.createDataFrame([("MAKES", "1:N")], "rel_type string, cardinality string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ontology.cardinality_violations(edges, rules)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in found.collect()] == [("MAKES", "p", "several_sources", 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan
