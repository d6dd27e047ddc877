"""Best paths against listing all of them, and evidence of all producers."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cinderpath.operators import paths as P


def _all_paths(near, start, end, hops):
    out, front = [], [[start]]
    for _ in range(hops):
        front = [[*p, b] for p in front for b in near.get(p[-1], ()) if b not in p]
        out += sorted(p for p in front if p[-1] == end)
        front = [p for p in front if p[-1] != end]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_best_paths_equal_all_paths_cut(spark, seed):
    rng = random.Random(seed)
    n = 14
    links = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([14, 22, 40]))}
    # A hub through which most paths run, so that labels that share a node crowd out the rest.
    links |= {(0, i) for i in range(1, 6)} | {(3, 3)}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    both = spark.createDataFrame([*links, *[(b, a) for a, b in links]], "a int, b int")
    pairs = [(a, b) for a in range(0, n, 2) for b in range(1, n, 3) if a != b] + [(1, 1), (2, 99)]
    for k, hops in ((3, 5), (2, 4)):
        got = P.best_paths(both, spark.createDataFrame([*pairs, pairs[0]], "start int, end int"), k, hops).collect()
        want = {(a, b, i, tuple(p)) for a, b in pairs if a != b for i, p in enumerate(_all_paths(near, a, b, hops)[:k], 1)}
        assert {(r.start, r.end, r.pick, tuple(r.path)) for r in got} == want and len(got) == len(want)


def test_paths_tell_names_and_predicates(spark):
    nodes = spark.createDataFrame([("a", "Ada", 0.9), ("b", "Bob", 0.6), ("c", "Cid", 0.3)], "id string, name string, relevance double")
    edges = spark.createDataFrame([("a", "b", "KNOWS"), ("b", "a", "HIRED"), ("c", "b", "LIKES")], "src string, dst string, predicate string")
    paths = spark.createDataFrame([("a", "c", 1, ["a", "b", "c"]), ("a", "x", 1, ["a", "x"])], "start string, end string, pick int, path array<string>")
    got = {r.key: r for r in P.path_evidence(paths, nodes, edges).collect()}
    first = got["a|c|1"]
    assert first.content == "[Reasoning Path] Ada →[HIRED]→ Bob →[LIKES]→ Cid" and first.length == 2 and first.score == pytest.approx(0.6 * 0.9)
    assert first.id == "ev_" + hashlib.sha256("path_a_c_0_Ada →[HIRED]→ Bob →[LIKES]→ Cid".encode()).hexdigest()[:12]
    assert got["a|x|1"].content == "[Reasoning Path] Ada →[UNKNOWN]→ x" and got["a|x|1"].score == pytest.approx(0.45)


def test_the_first_producer_wins(spark):
    node = lambda rows: spark.createDataFrame(rows, "id string, name string, description string, relevance double, distance int")
    nodes = node([("a", "Ada", "poet", 1.4, 0), ("b", "Bob", None, 0.2, 1), ("c", "Cid", "", 0.5, 2)])
    hits = spark.createDataFrame([("h1", "Ada: poet", 3.0), ("h2", "x" * 700, None), ("h3", None, 0.1)], "id string, text string, score double")
    found = spark.createDataFrame([("a", "Ada", "poet", 0.1), ("d", "Dee", None, None), ("e", None, None, 1.0)], "id string, name string, description string, score double")
    rows = spark.createDataFrame([("q", "n", 0, True, "y" * 300, None), ("r", None, 0, False, "", 0.4)], "id string, name string, zero int, flag boolean, long string, score double")
    edges = spark.createDataFrame([("a", "b", "KNOWS"), ("a", "zz", "KNOWS")], "src string, dst string, predicate string")
    groups = spark.createDataFrame([("g", "people", None), ("h", None, 1.0)], "id string, summary string, score double")
    producers = [P.edge_evidence(edges, nodes), P.description_evidence(nodes), P.chunk_evidence(hits), P.entity_evidence(found), P.community_evidence(groups), P.row_evidence(rows, ["id", "name", "zero", "flag", "long"])]
    got = {r.content[:40]: r for r in P.first_of_producers(producers).collect()}
    assert {c: r.producer for c, r in got.items()} == {"Ada KNOWS Bob": 1, "Ada: poet": 2, "x" * 40: 3, "Dee": 4, "[Community Context] people": 5, "[Query Result] name: n; flag: true; long": 6}
    assert got["Ada: poet"].score == 1.0 and got["Ada KNOWS Bob"].hop == 0 and len(got["x" * 40].content) == 500 and got["Dee"].score == 0.5
    assert got["[Query Result] name: n; flag: true; long"].content.endswith("y" * 200 + "...")
    assert P.first_of_producers(producers, 2).count() == 2
    assert P.first_of_producers([p.where(F.lit(False)) for p in producers]).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_best_paths_search_again_after_drops(spark, monkeypatch, seed):
    monkeypatch.setattr(P, "WIDTH", 1)
    rng = random.Random(seed)
    # Many early nodes lead on and back to the start alone; each has a walk to the end, but no path.
    links = {(0, i) for i in range(1, 9)} | {(i, rng.randrange(9, 12)) for i in range(1, 9)} | {(0, 20), (20, 21), (21, 22), (9, 20), (22, 30), (0, 23), (23, 21)}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    both = spark.createDataFrame([*links, *[(b, a) for a, b in links]], "a int, b int")
    pairs = [(0, 30), (30, 0), (1, 22)]
    got = {(r.start, r.end, r.pick, tuple(r.path)) for r in P.best_paths(both, spark.createDataFrame(pairs, "start int, end int"), 2, 5).collect()}
    assert got == {(a, b, i, tuple(p)) for a, b in pairs for i, p in enumerate(_all_paths(near, a, b, 5)[:2], 1)}


def test_best_paths_keep_few_labels_of_each_pair(spark, monkeypatch):
    written = []
    keep = P.cut
    monkeypatch.setattr(P, "cut", lambda df: written.append(keep(df)) or written[-1])
    makers, parts = range(100, 140), range(1000, 1060)
    links = [(m % 2, m) for m in makers] + [(m, p) for m in makers for p in parts]
    both = spark.createDataFrame([*links, *[(b, a) for a, b in links]], "a int, b int")
    got = P.best_paths(both, spark.createDataFrame([(0, 1)], "start int, end int")).collect()
    assert sorted((r.pick, tuple(r.path)) for r in got) == [(i + 1, (0, 100, 1000, m, 1)) for i, m in enumerate((101, 103, 105))]
    assert max(df.count() for df in written if "path" in df.columns) <= P.WIDTH + 1
