"""The graph queries over all edges against a search in memory."""

from collections import defaultdict

from cinderpath import plans
from cinderpath.plans.model import edges, entities

SF = "/root/testdata/sf0.001"


def _near(spark):
    near = defaultdict(set)
    for r in edges(spark, SF).select("src", "dst").collect():
        near[r.src].add(r.dst)
        near[r.dst].add(r.src)
    return near


def _distances(near, start, hops=None):
    seen, front, d = {start: 0}, {start}, 0
    while front and d != hops:
        d += 1
        front = {b for a in front for b in near[a]} - set(seen)
        seen |= dict.fromkeys(front, d)
    return seen


def test_components_of_all_edges(spark):
    near, want = _near(spark), {}
    for i in sorted(r.id for r in entities(spark, SF).select("id").collect()):
        if i not in want:
            want |= dict.fromkeys(_distances(near, i), i)
    got = {r.id: r.component for r in plans.QUERIES["whole_graph_components"](spark, SF).collect()}
    assert got == want and any(i.startswith("P:") and c != i for i, c in got.items())


def test_reach_over_all_edges(spark):
    near = _near(spark)
    want = {(s, n, d) for s in list(near) if s.startswith("R:") for n, d in _distances(near, s, 3).items()}
    want |= {(r.id, r.id, 0) for r in entities(spark, SF).where("id like 'R:%'").collect()}
    got = {tuple(r) for r in plans.QUERIES["whole_graph_reach"](spark, SF).collect()}
    assert got == want and any(n.startswith("P:") for _, n, _ in got)


def test_names_and_members_are_whole(spark):
    data = "/root/testdata/sf0.01"
    rows = lambda t: {r[0] for r in spark.read.parquet(f"{data}/{t[0]}.parquet").select(t[1]).collect()}
    want = set().union(*map(rows, [("region", "r_name"), ("nation", "n_name"), ("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name")]))
    assert {r.name for r in plans.QUERIES["all_distinct_names"](spark, data).collect()} == want
    members = [r.member for r in plans.QUERIES["all_community_members"](spark, data).collect()]
    assert sorted(members) == sorted([f"C:{i}" for i in rows(("customer", "c_custkey"))] + [f"S:{i}" for i in rows(("supplier", "s_suppkey"))])
