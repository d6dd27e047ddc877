"""Iterative graph operators: bounded expansion, shortest and simple paths, components, hierarchies.

`both` is a table of (a, b): every edge seen from both ends.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local one serves a local master; a cluster must name one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return shared or os.path.join(tempfile.gettempdir(), "cinderpath-graph")


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Writes within remove what was shuffled for them, but for what is under persisted tables, when they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, which ends its lineage, survives lost executors and tells Spark true sizes.

    A checkpoint would keep the estimated size of what it replaces, and estimates that loops of joins multiply grow without
    bound. The folder goes when the application ends; what was shuffled for it goes with the write, as a driver that has
    little to do collects no garbage, and would leave it on the executors' disks.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folder = f"{shared_folder(spark).rstrip('/')}/cut-{spark.sparkContext.applicationId}"
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    name = f"{folder}/{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(name)
    return spark.read.schema(df.schema).parquet(name)


def reach(both: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """start, node, distance: all nodes within so many hops of each seed, by the least distance.

    Each hop joins the frontier alone with the edges and drops what was seen before.
    """
    links = both.select("a", "b").distinct()
    seen = seeds.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("distance"))
    front = seen
    for d in range(1, hops + 1):
        new = front.select("start", F.col("node").alias("a")).join(links, "a").select("start", F.col("b").alias("node")).distinct()
        front = cut(new.join(seen, ["start", "node"], "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def shortest_paths(both: DataFrame, seeds: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """start, end, length, path: one shortest path for each pair that has one; ties go to the least path."""
    links = both.select("a", "b").distinct()
    ends = targets.select(F.col("id").alias("node"))
    front = seeds.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"))
    seen = front.select("start", "node")
    found = None
    for d in range(1, hops + 1):
        new = front.withColumnRenamed("node", "a").join(links, "a").select("start", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        new = new.join(seen, ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min("path").alias("path"))
        front = cut(new)
        seen = seen.unionByName(front.select("start", "node"))
        got = front.join(ends, "node", "left_semi").select("start", F.col("node").alias("end"), F.lit(d).alias("length"), "path")
        found = got if found is None else found.unionByName(got)
    return found


def simple_paths(both: DataFrame, seeds: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """start, end, path of every path without a repeated node, of at most so many hops."""
    links = both.select("a", "b").distinct()
    ends = targets.select(F.col("id").alias("node"))
    front = seeds.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"))
    found = None
    for _ in range(hops):
        front = front.withColumnRenamed("node", "a").join(links, "a").where(~F.array_contains("path", F.col("b")))
        front = cut(front.select("start", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path")))
        got = front.join(ends, "node", "left_semi").select("start", F.col("node").alias("end"), "path")
        found = got if found is None else found.unionByName(got)
    return found


def bridges(paths: DataFrame) -> DataFrame:
    """node, n: interior nodes of paths that lie on more of them than the mean interior node does."""
    inner = paths.where(F.size("path") > 2).select(F.explode(F.slice("path", F.lit(2), F.size("path") - 2)).alias("node"))
    counts = inner.groupBy("node").agg(F.count("*").alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    return counts.crossJoin(F.broadcast(mean)).where("n > mean").select("node", "n")


def components(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component (the least id of the component): least-label propagation with pointer jumping.

    A step is an aggregation, which combines before it shuffles, and two joins; the number of steps grows
    with the logarithm of the diameter in practice. Nodes without edges are components of their own.
    """
    links = cut(both.select("a", "b").where("a != b").distinct())
    label = cut(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        least = links.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = label.join(least, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = cut(step.join(jump, "component", "left").select("id", "old", F.least("component", "up").alias("component")))
        label = new.select("id", "component")
        if new.where("old != component").isEmpty():
            return label


def ancestors(parents: DataFrame, depth: int | None = None) -> DataFrame:
    """id, ancestor, distance (the least): the closure of (id, parent), to the end or to a depth.

    Each round joins only the pairs that the last one found, and keeps those not seen before, so that cycles end; what
    lies on a cycle is its own ancestor. Null ids and parents have none.
    """
    links = parents.where("id is not null and parent is not null").select("id", "parent").distinct()
    front = seen = cut(links.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    d = 1
    while d != depth and not front.isEmpty():
        d += 1
        up = front.select(F.col("id").alias("start"), F.col("ancestor").alias("id")).join(links, "id").select(F.col("start").alias("id"), F.col("parent").alias("ancestor")).distinct()
        front = cut(up.join(seen, ["id", "ancestor"], "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def hierarchy_faults(parents: DataFrame) -> DataFrame:
    """id, fault: rows with an undefined parent, and rows that are their own ancestor."""
    known = parents.select(F.col("id").alias("parent"))
    undefined = parents.where("parent is not null").join(known, "parent", "left_anti").select("id", F.lit("undefined_parent").alias("fault"))
    return undefined.unionByName(ancestors(parents).where("id = ancestor").select("id", F.lit("cycle").alias("fault")))
