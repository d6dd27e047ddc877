"""Seed subgraphs: a bounded expansion around the topics of many questions at once, with bridges and communities."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: Hops by type of question (others: 2), seeds and nodes of a subgraph, least quota of a frontier node.
HOPS = {"factoid": 1, "yesno": 1, "aggregation": 2, "comparison": 2, "multihop": 3, "bridge": 3}
SEEDS, CAPACITY, QUOTA = 5, 100, 3
#: Relevance of a node loses so much a hop, down to a floor; of bridges; of communities; and how many nodes and communities these take.
START, DECAY, FLOOR, BRIDGE, COMMUNITY, ASKING, COMMUNITIES = 0.9, 0.15, 0.3, 0.85, 0.6, 20, 5
#: Links of a task, about.
TASK_LINKS = 250_000


def hops(kind):
    """The depth of a question's type, as a column."""
    return reduce(lambda c, item: c.when(kind == item[0], item[1]), HOPS.items(), F.when(kind.isNull(), 2)).otherwise(2).cast("int")


def _near(both: DataFrame) -> DataFrame:
    """a, b, rel_type, r (the place among a's links, by b and type), once each, kept by a, so that searches don't shuffle them."""
    parts = math.ceil(both.count() / TASK_LINKS) or 1
    links = both.where("a is not null and b is not null and a <> b").select("a", "b", "rel_type").repartition(parts, "a").distinct()
    return links.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("b", "rel_type"))).persist()


def expand(both: DataFrame, seeds: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): breadth-first from each question's seeds, at most so many nodes a question.

    seeds has question, id, position (from 1), depth; both has a, b, rel_type. A round gives each frontier node a quota,
    the capacity left by the number of frontier nodes, three at least: that many of its links, by neighbour and type,
    are looked at, known neighbours included. Frontier nodes take their turns in the order in which they were found; a
    node belongs to the first that looks at it, and the round ends where the capacity does.

    nodes has question, id, distance, position; edges question, src (the frontier node), dst, rel_type. Links are
    numbered once (`_near`, which both may be already); questions are sent to them, and they to none.
    """
    links = both if "r" in both.columns else _near(both)
    depth = seeds.select("question", "depth").distinct()
    known = cut(seeds.select("question", "id", F.lit(0).alias("distance"), "position"))
    front, found_edges = known, None
    for hop in range(1, max(HOPS.values()) + 1):
        room = known.groupBy("question").agg(F.count("*").alias("n")).join(depth.where(F.col("depth") >= hop), "question").where(F.col("n") < capacity)
        room = front.groupBy("question").agg(F.count("*").alias("width")).join(room, "question").select("question", "n", F.greatest(F.lit(QUOTA), F.expr(f"({capacity} - n) div width")).alias("quota"))
        asking = front.join(room, "question").select("question", "n", "quota", F.col("id").alias("a"), F.col("position").alias("turn"))
        near = links.where(F.col("r") <= max(capacity, QUOTA))
        looked = near.join(asking.hint("shuffle_hash"), "a").where("r <= quota").join(known.select("question", F.col("id").alias("b")), ["question", "b"], "left_anti")
        first = looked.groupBy("question", "b").agg(F.min(F.struct("turn", "r", "a", "rel_type", "n")).alias("v")).select("question", "b", "v.*")
        place = F.row_number().over(Window.partitionBy("question").orderBy("turn", "r"))
        new = cut(first.withColumn("position", (F.col("n") + place).cast("int")).where(F.col("position") <= capacity))
        front = new.select("question", F.col("b").alias("id"), F.lit(hop).alias("distance"), "position")
        known = known.unionByName(front)
        step = new.select("question", F.col("a").alias("src"), F.col("b").alias("dst"), "rel_type")
        found_edges = step if found_edges is None else found_edges.unionByName(step)
    return known, found_edges


def meetings(both: DataFrame, pairs: DataFrame) -> DataFrame:
    """start, end, path: the shortest path of each pair within four hops, among equal ones the least by its nodes.

    Both ends are searched at once, two hops each at most, and only for pairs that nothing shorter joins. Of the ways
    to a node that are equally long the least is kept, from either end, so a round has one row a node and end.
    """
    links = both.select("a", "b") if "r" in both.columns else cut(both.where("a <> b").select("a", "b").distinct())
    open_ = cut(pairs.select("start", "end").where("start <> end").distinct())

    def onward(front: DataFrame, ahead: bool) -> DataFrame:
        path = F.concat("path", F.array("b")) if ahead else F.concat(F.array("b"), "path")
        step = links.join(front.withColumnRenamed("node", "a").hint("shuffle_hash"), "a").where(~F.array_contains("path", F.col("b")))
        return step.groupBy("root", F.col("b").alias("node")).agg(F.min(path).alias("path"))

    def ends(column: str) -> DataFrame:
        return open_.select(F.col(column).alias("root")).distinct().select("root", F.col("root").alias("node"), F.array("root").alias("path"))

    left, right, found = ends("start"), ends("end"), None
    for length in range(1, 5):
        still = lambda front, column: front.join(open_.select(F.col(column).alias("root")).distinct(), "root", "left_semi")
        if length % 2:
            left = cut(onward(still(left, "start"), True))
        else:
            right = cut(onward(still(right, "end"), False))
        a = left.select(F.col("root").alias("start"), "node", F.col("path").alias("head"))
        b = right.select(F.col("root").alias("end"), "node", F.slice("path", F.lit(2), F.size("path")).alias("tail"))
        got = open_.join(a, "start").join(b, ["end", "node"]).groupBy("start", "end").agg(F.min(F.concat("head", "tail")).alias("path"))
        got = cut(got)
        found = got if found is None else found.unionByName(got)
        open_ = cut(open_.join(got, ["start", "end"], "left_anti"))
        if open_.isEmpty():
            break
    return found


def seed_subgraphs(edges: DataFrame, topics: DataFrame, members: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each question's subgraph.

    edges has src, dst, rel_type; topics question, kind (its type), id, score, of which the five best count (ties: the
    least id); members id, community. nodes has question, id, distance, relevance, origin (seed, neighbor, bridge or
    community), position; edges question, src, dst, rel_type. Questions of two hops or more with two seeds or more also
    get the inner nodes of the shortest path between each two seeds, and all edges among their nodes; the first twenty
    nodes their five first communities. These come on top of the capacity: three nodes a pair and five at most.
    Topics without an id or question are left out; ids that no edge has stand alone. Edges are read three times.
    """
    edges = edges.select("src", "dst", "rel_type")
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel_type"))
    both = _near(both)
    once = topics.where("question is not null and id is not null").groupBy("question", "id").agg(F.max("score").alias("score"), F.min("kind").alias("kind"))
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    least = F.min("kind").over(Window.partitionBy("question"))
    seeds = cut(once.withColumn("position", rank).withColumn("kind", least).where(F.col("position") <= min(SEEDS, capacity)).withColumn("depth", hops(F.col("kind"))))
    known, walked = expand(both, seeds, capacity)
    score = seeds.select("question", "id", "score")
    relevance = F.when(F.col("distance") == 0, F.coalesce("score", F.lit(1.0))).otherwise(F.greatest(F.lit(FLOOR), F.lit(START) - F.col("distance") * DECAY))
    origin = F.when(F.col("distance") == 0, "seed").otherwise("neighbor")
    nodes = cut(known.join(score, ["question", "id"], "left").select("question", "id", "distance", F.round(relevance, 6).alias("relevance"), origin.alias("origin"), "position"))

    deep = seeds.where("depth >= 2")
    one, other = (deep.select("question", F.col("id").alias(c), F.col("position").alias(p)) for c, p in (("start", "i"), ("end", "j")))
    pairs = cut(one.join(other, "question").where("i < j"))
    inner = pairs.join(meetings(both, pairs), ["start", "end"]).where("size(path) > 2")
    inner = inner.select("question", "i", "j", F.posexplode(F.slice("path", F.lit(2), F.size("path") - 2)).alias("k", "id"))
    inner = inner.join(nodes.select("question", "id"), ["question", "id"], "left_anti").groupBy("question", "id").agg(F.min(F.struct("i", "j", "k")).alias("at"))
    last = nodes.groupBy("question").agg(F.max("position").alias("last"))
    place = lambda *by: (F.col("last") + F.row_number().over(Window.partitionBy("question").orderBy(*by))).cast("int").alias("position")
    inner = inner.join(last, "question").select("question", "id", F.lit(1).alias("distance"), F.lit(BRIDGE).alias("relevance"), F.lit("bridge").alias("origin"), place("at", "id"))
    nodes = cut(nodes.unionByName(inner))
    both.unpersist()

    joined = pairs.select("question").distinct()
    ids = nodes.join(joined, "question", "left_semi").select("question", "id")
    # Each edge is looked for from the end that fewer questions have, so that hubs' edges aren't listed for all that have a hub.
    asked = cut(ids.groupBy("id").agg(F.count("*").alias("n")))
    fit = edges.where("src <> dst").join(asked.toDF("src", "n"), "src").join(asked.toDF("dst", "m"), "dst")
    fit = fit.select("src", "dst", "rel_type", F.when(F.col("n") <= F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("id"))
    among = fit.join(ids, "id").withColumn("other", F.when(F.col("id") == F.col("src"), F.col("dst")).otherwise(F.col("src")))
    among = among.join(ids.withColumnRenamed("id", "other"), ["question", "other"], "left_semi")

    early = nodes.where(F.col("position") <= ASKING).select("question", "id")
    near = early.join(members.where("community is not null").select("id", "community").distinct(), "id")
    new = near.select("question", F.col("community").alias("id")).distinct().withColumn("r", F.row_number().over(Window.partitionBy("question").orderBy("id"))).where(F.col("r") <= COMMUNITIES)
    new = new.join(nodes.select("question", "id"), ["question", "id"], "left_anti")
    last = nodes.groupBy("question").agg(F.max("position").alias("last"))
    groups = cut(new.join(last, "question").select("question", "id", F.lit(1).alias("distance"), F.lit(COMMUNITY).alias("relevance"), F.lit("community").alias("origin"), place("id")))
    belongs = near.join(groups.select("question", F.col("id").alias("community")), ["question", "community"]).select("question", F.col("id").alias("src"), F.col("community").alias("dst"), F.lit("BELONGS_TO").alias("rel_type"))
    columns = ["question", "src", "dst", "rel_type"]
    return nodes.unionByName(groups), walked.unionByName(among.select(columns)).unionByName(belongs).distinct()
