"""Seed subgraphs against a search that takes one node after another."""

import random

import pytest

from cinderpath.operators import seeds as S


def _paths(links, start, end):
    """The least of the shortest paths within four hops."""
    front = [[start]]
    for _ in range(4):
        front = [p + [b] for p in front for b in links.get(p[-1], ()) if b not in p]
        if got := [p for p in front if p[-1] == end]:
            return min(got)
    return None


def _brute(edges, topics, members, capacity):
    typed = {}
    for a, b, t in set(edges):
        if a != b:
            typed.setdefault(a, set()).add((b, t))
            typed.setdefault(b, set()).add((a, t))
    links = {a: {b for b, _ in v} for a, v in typed.items()}
    nodes, found = set(), set()
    for question in sorted({q for q, _, i, _ in topics if q is not None and i is not None}):
        mine = {}
        for q, _, i, s in topics:
            if q == question and i is not None:
                mine[i] = max(mine.get(i, s), s)
        kind = min(k for q, k, i, _ in topics if q == question and i is not None)
        depth = S.HOPS.get(kind, 2)
        first = sorted(mine, key=lambda i: (-mine[i], i))[: min(5, capacity)]
        known = {i: (0, round(mine[i], 6), "seed") for i in first}
        front = first
        for hop in range(1, depth + 1):
            if len(known) >= capacity or not front:
                break
            quota, new = max(3, (capacity - len(known)) // len(front)), []
            for a in front:
                for b, t in sorted(typed.get(a, ()))[:quota]:
                    if b not in known and len(known) < capacity:
                        known[b] = (hop, round(max(0.3, 0.9 - hop * 0.15), 6), "neighbor")
                        new.append(b)
                        found.add((question, a, b, t))
            front = new
        if depth >= 2 and len(first) >= 2:
            for x, a in enumerate(first):
                for b in first[x + 1 :]:
                    for n in (_paths(links, a, b) or [])[1:-1]:
                        known.setdefault(n, (1, 0.85, "bridge"))
            found |= {(question, a, b, t) for a, b, t in edges if a != b and a in known and b in known}
        early = list(known)[:20]
        near = {(i, c) for i, c in members if i in early and c is not None}
        for c in sorted({c for _, c in near})[:5]:
            if c not in known:
                known[c] = (1, 0.6, "community")
                found |= {(question, i, c, "BELONGS_TO") for i, d in near if d == c}
        nodes |= {(question, i, *v, p) for p, (i, v) in enumerate(known.items(), 1)}
    return nodes, found


@pytest.mark.parametrize(("seed", "capacity"), [(1, 100), (2, 7), (3, 4)])
def test_equals_search_in_order(spark, seed, capacity):
    rng = random.Random(seed)
    name = lambda: f"n{rng.choice([0, 0, rng.randrange(60), rng.randrange(60)]):02d}"  # noqa: E731  n00 is a hub
    edges = [(name(), name(), rng.choice("AB")) for _ in range(110)] + [("n01", "n01", "A")]
    kinds = [*S.HOPS, "other"]
    topics = [(q, kinds[q % len(kinds)], name(), rng.choice([0.25, 0.5, 1.0])) for q in range(14) for _ in range(rng.randrange(1, 8))]
    topics += [(3, kinds[3], "nowhere", 2.0), (None, "bridge", "n01", 1.0), (4, kinds[4], None, 1.0)]
    members = [(f"n{i:02d}", rng.choice(["k1", "k2", "k3", "k4", "k5", "k6", "k7", None])) for i in range(60) for _ in range(2)]
    frame = spark.createDataFrame
    nodes, found = S.seed_subgraphs(
        frame(edges, "src string, dst string, rel_type string"), frame(topics, "question int, kind string, id string, score double"), frame(members, "id string, community string"), capacity
    )
    want = _brute(edges, topics, members, capacity)
    got = [(r.question, r.id, r.distance, r.relevance, r.origin, r.position) for r in nodes.collect()]
    assert len(got) == len(set(got)) and set(got) == want[0]
    assert {(r.question, r.src, r.dst, r.rel_type) for r in found.collect()} == want[1]
    assert all(p <= capacity for *_, origin, p in got if origin in ("seed", "neighbor"))
    origins = {o for *_, o, _ in got}
    assert {"seed", "community"} <= origins and (capacity > 4 or "bridge" in origins)


def test_empty_tables(spark):
    frame = spark.createDataFrame
    nodes, found = S.seed_subgraphs(frame([], "src string, dst string, rel_type string"), frame([(1, "bridge", "a", 1.0), (1, "bridge", "b", 1.0)], "question int, kind string, id string, score double"), frame([], "id string, community string"))
    assert [(r.id, r.origin) for r in nodes.orderBy("id").collect()] == [("a", "seed"), ("b", "seed")] and found.count() == 0
