"""What the findings after round 4 found to take too long or too much disk."""

from __future__ import annotations

import random
import time
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cinderpath.operators import communities as M
from cinderpath.operators import paths as P
from cinderpath.operators import seeds as S
from cinderpath.streaming import loads


def _counted(df, folder):
    """df, which leaves a file in the folder for each row that is read."""

    def told(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                (folder / uuid.uuid4().hex).touch()
            yield batch

    return df.mapInArrow(told, df.schema)


def test_louvain_reads_its_edges_once(spark, tmp_path):
    links = [(i, i // 4 * 4) for i in range(24)] + [(i, i // 4 * 4 + 1) for i in range(24)] + [(4, 8)]
    edges = _counted(spark.createDataFrame(links, "src int, dst int"), tmp_path)
    rows = M.louvain(edges, spark.createDataFrame([(i,) for i in range(25)], "id int")).collect()
    assert len(list(tmp_path.iterdir())) == len(links)
    assert {(r["id"], r["community"]) for r in rows if r["level"] == 1} >= {(24, 24)}


def test_louvain_sums_weights_of_nodes_and_contracts_without_moving_links(spark):
    kept = M._links(M._both(spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 3, 0.5)], "src int, dst int, weight double"), 3))
    degree = kept.groupBy("b").agg({"w": "sum"})
    assert sorted(map(tuple, degree.collect())) == [(1, 1.0), (2, 3.0), (3, 3.0)]
    assert "Exchange" not in degree._jdf.queryExecution().executedPlan().toString().partition("InMemoryTableScan")[0]
    to = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node int, community int")
    assert sorted(map(tuple, M._contracted(kept, to).collect())) == [(1, 1, 2.0), (1, 3, 2.0), (3, 1, 2.0), (3, 3, 1.0)]
    kept.unpersist()


def test_cut_leaves_no_shuffle_files(spark, tmp_path):
    """Also where the driver collects no garbage; what is under a persisted table can still be read, and the setting is as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    was = spark.conf.get(key, None)
    held = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().persist()
    assert held.count() == 7
    before = files()
    rows = M.cut(held.groupBy("count").agg(F.max("k").alias("k")).repartition(3, "k").distinct())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert rows.count() == 2 and held.groupBy("k").count().count() == 7
    assert spark.conf.get(key, None) in (was, "false")
    held.unpersist()


def test_links_of_hubs_are_not_listed_for_all_who_have_the_hub(spark):
    """Of 300 questions that share a hub with 400 links, each sees only those to its own nodes; links aren't shuffled to hops."""
    links = [("hub", f"x{i}") for i in range(400)]
    edges = spark.createDataFrame([(a, b, "L") for a, b in links], "src string, dst string, rel_type string")
    topics = spark.createDataFrame([(q, "open", t, 1.0) for q in range(300) for t in ("hub", f"x{q}")], "question int, kind string, id string, score double")
    nodes, found = S.seed_subgraphs(edges, topics, spark.createDataFrame([], "id string, community string"), 2)
    assert sorted(map(tuple, found.collect())) == sorted((q, "hub", f"x{q}", "L") for q in range(300)) and nodes.count() == 600
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    assert _most(plan) < 3000


def _most(plan) -> int:
    """The greatest number of rows that a join of the plan made."""
    text, most = plan.nodeName(), 0
    if "Join" in text:
        most = plan.metrics().apply("numOutputRows").value()
    if text == "AdaptiveSparkPlan":
        return _most(plan.executedPlan())
    if "QueryStage" in text:
        return _most(plan.plan())
    kids = plan.children()
    return max([most, *(_most(kids.apply(i)) for i in range(kids.size()))])


def test_loads_leave_neither_shuffle_files_nor_their_batch(spark, tmp_path):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    path = str(tmp_path / "store")
    names = [c.split()[0] for c in loads.RECORDS.split(", ")]
    made = lambda kind, **v: tuple({"kind": kind, **v}.get(c) for c in names)
    rows = [made("entity", id=str(i), name=f"n{i}", chunk_ids=["c"]) for i in range(50)] + [made("relation", src=str(i), predicate="P", dst="0", confidence=0.5) for i in range(50)] + [made("other")]
    before = files()
    assert loads.load(spark.createDataFrame(rows, loads.RECORDS), path, "t", 0)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and not (tmp_path / "store" / "batch").exists()
    assert loads.load(spark.createDataFrame([], loads.RECORDS), path, "t", 1)
    assert sorted(map(tuple, loads.report(spark, path).collect())) == [(0, "entity", "NEW", 50), (0, "link", "NEW", 50), (0, "other", "IGNORED", 1), (0, "relation", "NEW", 50)]


def test_loads_shuffle_no_hashes(spark):
    plan = loads._incoming(spark.createDataFrame([], loads.RECORDS), "relation")._jdf.queryExecution().analyzed().toString()
    above, found, below = plan.partition("RepartitionByExpression")
    assert found and "unhex" in above and "sha2" not in below


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_and_last_links_tell_what_all_links_do(spark, monkeypatch, seed):
    """The steps before an end are those of all links, also where only some nodes are told by their first and last ones."""
    draw = random.Random(seed)
    pairs = {(draw.randrange(5), draw.randrange(5, 25)) for _ in range(60)} | {(0, x) for x in range(5, 25)}
    both = spark.createDataFrame([*pairs, *((b, a) for a, b in pairs)], "a int, b int")
    ends = spark.createDataFrame([(0,), (7,), (11,)], "end int")
    links = P.cut(P._ranked(both))
    steps = {}
    for edge in (1, 2, 1000):
        monkeypatch.setattr(P, "EDGE", edge)
        back = None
        for d in range(4):
            back = P.cut(P._before(links, back, ends))
            steps.setdefault(d, []).append(sorted(map(tuple, back.collect())) if d else [])
    assert all(x == y == z for x, y, z in steps.values())
    assert len(steps[3][0]) > 20


def test_evidence_derives_edges_once(spark, monkeypatch):
    from cinderpath.plans import evidence_paths as Q

    calls, edges = [], Q.edges
    monkeypatch.setattr(Q, "edges", lambda *a: calls.append(a) or edges(*a))
    Q.extracted_evidence(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
