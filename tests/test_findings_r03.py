"""Findings of round 3: clusters of names without all their pairs."""

from __future__ import annotations

import os
import random

import pytest

from cinderpath.operators import graph as G
from cinderpath.operators import resolve as R
from cinderpath.plans import model


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _clusters(names: list[tuple[str, str, str]], least: float) -> dict[str, str]:
    top = {i: i for i, _, _ in names}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, t, a in names:
        for j, u, b in names:
            if i < j and t == u and _distance(a, b) <= int((1 - least) * max(len(a), len(b)) + 1e-9):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return {i: find(i) for i in top}


@pytest.mark.parametrize("least", [0.85, 0.8])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_are_those_of_all_pairs(spark, seed, least):
    """Names around the lengths at which another edit is allowed, two edits or more from others of many lengths."""
    draw = random.Random(seed)
    bases = ["".join(draw.choice("abcd") for _ in range(n)) for n in (5, 6, 7, 8, 12, 13, 14, 15, 18, 19, 20, 21, 26, 27)]
    rows = []
    for _ in range(170):
        name = list(draw.choice(bases))
        for _ in range(draw.randint(1, 4)):
            at, what = draw.randrange(len(name)), draw.randrange(3)
            name[at : at + (what != 0)] = [] if what == 1 else [draw.choice("abcdé")]
        rows.append((f"i{len(rows):04d}", draw.choice("xy"), "".join(name) or "a"))
    got = {r["id"]: r["cluster"] for r in R.resolve(spark.createDataFrame(rows, "id string, type string, name string"), least).collect()}
    # The normal form drops an article at the start and nothing else of these names, which have no blanks.
    assert got == _clusters(rows, least)


def test_numbered_names_make_links_by_name_not_by_pair(spark):
    """Names that differ in digits alone: links a name stay the same, where near pairs grow with the names."""
    counts = []
    for n in (100, 1000):
        rows = [(f"i{i:06d}", "t", f"customer#{i:09d}") for i in range(n)]
        nodes = spark.createDataFrame(rows, "rep string, type string, norm string")
        assert R._pairs(nodes, 0.85, R.FEW).count() == 0
        counts.append(R._near_links(nodes, 0.85).count() / n)
    assert counts[1] < 2 * counts[0] and counts[1] < 171


def test_tables_that_compress_well_are_not_estimated_small(spark):
    """Spark's estimate of a cut table is near its rows' size, so that it isn't sent to the driver for a join."""
    model.edges(spark, "/root/testdata/sf0.001")
    rows = G.cut(spark.range(400_000).selectExpr("concat('S:', pmod(xxhash64(id), 1000000)) AS question", "concat('node of a long common name ', pmod(xxhash64(-id), 1000000)) AS id"))
    files = sum(os.path.getsize(f.removeprefix("file://")) for f in rows.inputFiles())
    assert files < 10 << 20 < int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_a_task_after_a_shuffle_gets_a_bounded_share(spark):
    was = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB")
        model.edges(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) == 16 << 20
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
        model.edges(spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)
