"""What the findings after round 3 found to grow faster than the tables, or not to end."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cinderpath import plans
from cinderpath.operators import communities as M
from cinderpath.operators import ontology as O
from cinderpath.operators import text_index as X
from cinderpath.streaming import loads


def test_louvain_sums_up_what_moves_change_without_all_edges(spark):
    """What a half's moves add inside communities, at once, is what a pass over all edges finds."""
    draw = random.Random(2)
    links = [(draw.randrange(40), draw.randrange(40), draw.choice([0.5, 1.0, 3.0])) for _ in range(150)] + [(4, 4, 2.0)]
    both = M.cut(M._both(spark.createDataFrame(links, "src int, dst int, weight double")))
    total = both.agg(F.sum("w")).first()[0]
    kept = M._links(both, 2)
    labels = both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")).withColumn("community", F.col("id") % 7)
    squares = lambda x: M._squares(x).first()[0] / total**2
    for half in (0, 1):
        moves = M.cut(M._moves(kept, labels, total, half, 2))
        assert moves.count() > 3 and moves.where(F.pmod(F.col("id"), F.lit(2)) != half).isEmpty()
        tried = labels.join(moves.select("id", F.col("community").alias("to")), "id", "left").select("id", F.coalesce("to", "community").alias("community"), "k")
        gain = M._inner_gain(kept, moves, half).agg(F.sum("s")).first()[0] / total - squares(tried) + squares(labels)
        assert gain == pytest.approx(M.modularity(both, tried) - M.modularity(both, labels))


def test_texts_are_indexed_where_their_blocks_are(spark, tmp_path):
    """A block of documents is written by one task, so that postings aren't shuffled; also with a label that is a literal."""
    docs = spark.range(2000).select(F.lit("A").alias("label"), "id", F.concat(F.lit("red w"), F.col("id") % 50).alias("text"))
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        index = X.write_index(docs, str(tmp_path / "i"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    files = index.blocks.groupBy("block").agg(F.countDistinct(F.col("_metadata.file_name")).alias("n"))
    assert files.count() > 8 and files.where("n > 1").isEmpty()


def test_texts_are_searched_once_for_all_questions(spark):
    """No search in texts, or in questions, above the step that gives each text all questions."""
    plan = plans.QUERIES["evidence_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Generate explode")
    assert "regexp_extract_all" in below and not any(f in above for f in ("regexp", "RegExp", "Contains"))


def test_inference_writes_each_fact_once(spark, monkeypatch):
    written = []

    def cut(df):
        written.append(M.cut(df))
        return written[-1]

    monkeypatch.setattr(O, "cut", cut)
    facts = spark.createDataFrame([(i, "PART_OF", i + 1) for i in range(12)], "src int, predicate string, dst int")
    assert O.inferred(facts, O.base_predicates(spark)).count() == 12 * 13 // 2 == sum(d.count() for d in written)


def test_loads_shuffle_hashes_once_as_bytes(spark):
    """The aggregation that finds a key's newest row doesn't carry hashes as text besides."""
    records = spark.createDataFrame([], loads.RECORDS)
    newest = loads._incoming(records, "relation")._jdf.queryExecution().analyzed().toString()
    assert "unhex" in newest and "content_hash" not in newest[newest.index("Aggregate") :]
