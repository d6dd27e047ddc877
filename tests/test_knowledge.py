"""Inference, ontology checks and Louvain communities."""

import random

import pytest

from cinderpath.operators import communities as M
from cinderpath.operators import ontology as O


@pytest.mark.parametrize("seed", range(3))
def test_inference_reaches_the_naive_fixpoint(spark, seed):
    rng = random.Random(seed)
    rules = {"t": (False, None, True), "s": (True, None, False), "i": (False, "j", False), "j": (False, "t", True), "st": (True, None, True), "n": (False, None, False)}
    facts = {(rng.randrange(9), rng.choice(list(rules)), rng.randrange(9)) for _ in range(14)}
    want = set(facts)
    while True:
        new = set()
        for a, p, b in want:
            symmetric, inverse, transitive = rules[p]
            if symmetric:
                new.add((b, p, a))
            if inverse:
                new.add((b, inverse, a))
            if transitive:
                new |= {(a, p, d) for c, q, d in want if q == p and c == b}
        if new <= want:
            break
        want |= new
    rows = [*facts, *facts, (None, "t", 1), (1, "t", None)]
    table = spark.createDataFrame([(p, *r) for p, r in rules.items()], "predicate string, symmetric boolean, inverse string, transitive boolean")
    got = O.inferred(spark.createDataFrame(rows, "src int, predicate string, dst int"), table).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_long_chain_is_inferred_to_its_end(spark):
    rows = spark.createDataFrame([(i, "PART_OF", i + 1) for i in range(40)], "src int, predicate string, dst int")
    assert O.inferred(rows, O.base_predicates(spark)).count() == 40 * 41 // 2


def test_the_base_ontology_has_two_warnings(spark):
    got = {(r.level, r.kind, r.name, r.message) for r in O.ontology_faults(O.base_types(spark), O.base_predicates(spark)).collect()}
    assert got == {
        ("warning", "inverse", "SUBSIDIARY_OF", "Inverse predicate 'PARENT_OF' not found"),
        ("warning", "inverse_mismatch", "CONTAINS", "Inverse predicate 'PART_OF' does not reference back"),
    }
    types = spark.createDataFrame([("A", "B", []), ("B", "A", []), ("C", "Z", [])], "type string, parent string, aliases array<string>")
    faults = {(r.level, r.kind, r.name) for r in O.ontology_faults(types, O.base_predicates(spark).where("predicate = 'CEO_OF'")).collect()}
    assert faults == {("error", "hierarchy", "A"), ("error", "hierarchy", "B"), ("error", "hierarchy", "C"), ("warning", "predicate_domain", "CEO_OF"), ("warning", "predicate_range", "CEO_OF")}


def test_types_resolve_by_alias(spark):
    rows = spark.createDataFrame([("company",), (" Gpe ",), ("person",), ("nothing",), (None,)], "kind string")
    assert {r.kind: r.resolved for r in O.resolved_types(rows, "kind", O.base_types(spark)).collect()} == {"company": "ORGANIZATION", " Gpe ": "LOCATION", "person": "PERSON", "nothing": None, None: None}


def test_louvain_finds_planted_groups(spark):
    rng = random.Random(3)
    links = [(10 * g + i, 10 * g + j) for g in range(6) for i in range(10) for j in range(i) if rng.random() < 0.8]
    links += [(10 * g, 10 * ((g + 1) % 6)) for g in range(6)]
    edges = spark.createDataFrame(links, "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in range(62)], "id int")
    rows = M.louvain(edges, nodes).collect()
    last = max(r.level for r in rows)
    found = {r.id: r.community for r in rows if r.level == last}
    first = {r.id: r.community for r in rows if r.level == 1}
    assert any({i: (i // 10 * 10 if i < 60 else i) for i in range(62)} == level for level in (found, first))
    both = M._both(edges)
    levels = [M.modularity(both, spark.createDataFrame([(r.id, r.community) for r in rows if r.level == k], "id int, community int")) for k in range(1, last + 1)]
    alone = M.modularity(both, nodes.selectExpr("id", "id as community"))
    assert levels == sorted(levels) and levels[0] > alone
    share = {k: sum(x // 10 == y // 10 for x, y in links) / len(links) for k in (0,)}[0]
    assert levels[-1] == pytest.approx(share - 6 * (1 / 6) ** 2, abs=0.02)
    names = nodes.selectExpr("id", "concat('n', id) as name")
    members = spark.createDataFrame([(i, 1, i // 10 * 10 if i < 60 else i) for i in range(62)], "id int, level int, community int")
    sizes = {r.community: (r.size, r.summary) for r in M.sized(members, names).collect()}
    assert sizes[10] == (10, "n10, n11, n12") and sorted(sizes) == list(range(0, 60, 10))


def test_moves_never_lower_modularity(spark, monkeypatch):
    monkeypatch.setattr(M, "ROUNDS", 6)
    rng = random.Random(5)
    links = [(rng.randrange(30), rng.randrange(30), rng.choice([0.5, 1.0, 3.0, 0.0, None])) for _ in range(60)] + [(None, 3, 1.0), (4, 4, 2.0)]
    edges = spark.createDataFrame(links, "src int, dst int, weight double")
    seen = []
    plain = M.modularity
    both = M._both(edges)
    rows = M.louvain(edges, spark.createDataFrame([], "id int"), 2).collect()
    for k in range(1, max(r.level for r in rows) + 1):
        seen.append(plain(both, spark.createDataFrame([(r.id, r.community) for r in rows if r.level == k], "id int, community int")))
    assert seen == sorted(seen)


def test_louvain_of_empty_tables(spark):
    rows = M.louvain(spark.createDataFrame([], "src int, dst int"), spark.createDataFrame([(1,), (None,)], "id int")).collect()
    assert [tuple(r) for r in rows] == [(1, 1, 1)]
