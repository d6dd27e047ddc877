"""Graph pattern matching: scans, filters, joins along edges, anti joins and set operations on a node and an edge table.

Nodes have id, name, type and further columns; edges src, dst, rel_type and further columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import reach


def contains_ci(column: str, needle: str) -> Column:
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(needle.lower()))


def any_field_contains(fields: list[str], needle: str) -> Column:
    return reduce(lambda a, b: a | b, (contains_ci(f, needle) for f in fields))


def any_contains(text: str, needles: list[str]) -> Column:
    """Whether a text contains one of some names."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(n)) for n in needles))


def active(nodes: DataFrame) -> DataFrame:
    """Rows that aren't soft-deleted; null counts as not deleted."""
    return nodes.where(~F.coalesce("is_deleted", F.lit(False)))


def missing_fields(nodes: DataFrame, required: list[str]) -> DataFrame:
    """Rows that lack a required field, with the comma-joined names of what they lack."""
    missing = F.concat_ws(",", *(F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in required))
    return nodes.withColumn("missing", missing).where("missing != ''")


def one_hop(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Directed edges with the names and types of both ends."""
    a = nodes.select(F.col("id").alias("src"), F.col("name").alias("src_name"), F.col("type").alias("src_type"))
    b = nodes.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"), F.col("type").alias("dst_type"))
    return edges.join(a, "src").join(b, "dst")


def between(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The induced subgraph's edges: both ends among the ids."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def two_hops(both: DataFrame, start: DataFrame) -> DataFrame:
    """start, hop2: nodes two undirected edges away, over two different edges, other than the start.

    Repeated and parallel edges are one before the second hop, so a hub's row is joined once for each start.
    """
    links = both.select("a", "b").distinct()
    first = start.select(F.col("id").alias("a")).distinct().join(links, "a").select(F.col("a").alias("start"), F.col("b").alias("a"))
    return first.join(links, "a").where("b != start").select("start", F.col("b").alias("hop2")).distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Active nodes without any edge."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return active(nodes).join(ends, "id", "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with a deleted end."""
    gone = nodes.where(F.coalesce("is_deleted", F.lit(False)))
    a = gone.select(F.col("id").alias("src"), F.lit(True).alias("src_deleted"))
    b = gone.select(F.col("id").alias("dst"), F.lit(True).alias("dst_deleted"))
    out = edges.join(a, "src", "left").join(b, "dst", "left").where("src_deleted or dst_deleted")
    return out.select("src", "dst", "rel_type", F.coalesce("src_deleted", F.lit(False)).alias("src_deleted"), F.coalesce("dst_deleted", F.lit(False)).alias("dst_deleted"))


def inconsistent(nodes: DataFrame, both: DataFrame) -> DataFrame:
    """Deleted nodes that still have edges, with their number."""
    gone = nodes.where(F.coalesce("is_deleted", F.lit(False))).select("id")
    return gone.join(both.select(F.col("a").alias("id")), "id").groupBy("id").agg(F.count("*").alias("n_edges"))


def changes(old: DataFrame, new: DataFrame, keys: list[str], content: list[str], extra: list[str] = ()) -> DataFrame:
    """Keys and change of each incoming row against the stored ones: NEW, MODIFIED, EXTRA_ONLY or UNCHANGED.

    Content and extra columns are compared by hashes of canonical JSON, so the join carries two numbers a row.
    """
    digest = lambda cols: F.sha2(F.to_json(F.struct(*sorted(cols))), 256) if cols else F.lit("")
    a = old.select(*keys, digest(content).alias("old_hash"), digest(list(extra)).alias("old_extra"))
    b = new.select(*keys, digest(content).alias("new_hash"), digest(list(extra)).alias("new_extra"))
    change = F.when(F.col("old_hash").isNull(), "NEW").when(F.col("old_hash") != F.col("new_hash"), "MODIFIED").when(F.col("old_extra") != F.col("new_extra"), "EXTRA_ONLY").otherwise("UNCHANGED")
    return b.join(a, keys, "left").select(*keys, change.alias("change"))


def merge_graphs(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of two subgraphs: nodes by id (left wins), edges by (src, dst, rel_type)."""
    nodes = left[0].unionByName(right[0].join(left[0].select("id"), "id", "left_anti"))
    keys = ["src", "dst", "rel_type"]
    return nodes, left[1].unionByName(right[1].join(left[1].select(*keys), keys, "left_anti"))


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an order, as one aggregation (no window, no sort of groups)."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    return rows.groupBy(*keys).agg(best).select(*keys, *(f"r.{c}" for c in rest))


def neighbors(edges: DataFrame, seeds: DataFrame, types: list[str] | None = None, direction: str = "both", hops: int = 1) -> DataFrame:
    """start, node, distance of all nodes within some hops of the seeds, along edges of some types (all if None), out, in or both ways."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction}")
    rows = edges if types is None else edges.where(F.col("rel_type").isin(*types))
    out, back = rows.select(F.col("src").alias("a"), F.col("dst").alias("b")), rows.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    both = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return reach(both, seeds, hops).where("distance > 0")


def mention_links(mentions: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk, entity: one row for each chunk that an entity names in its list `chunk_ids`, where both exist."""
    links = mentions.select(F.col("id").alias("entity"), F.explode("chunk_ids").alias("chunk")).distinct()
    return links.join(entities.select(F.col("id").alias("entity")), "entity", "left_semi").join(chunks.select(F.col("id").alias("chunk")), "chunk", "left_semi").select("chunk", "entity")


def accepted_entities(rows: DataFrame, least: float, types: list[str]) -> DataFrame:
    """Extracted entities of enough confidence and an allowed type, with a name."""
    return rows.where((F.col("confidence") >= least) & F.col("type").isin(*types) & (F.trim(F.coalesce("name", F.lit(""))) != ""))


def accepted_relations(rows: DataFrame, names: DataFrame, least: float, predicates: list[str]) -> DataFrame:
    """source_id, target_id, predicate, confidence of extracted relations (source, target, predicate, confidence) of enough confidence
    and an allowed predicate, whose ends are known by a name or an alias (names: name, id), whatever its case; ties go to the least id."""
    known = names.groupBy(F.lower(F.trim("name")).alias("norm")).agg(F.min("id").alias("id"))
    end = lambda c: known.select(F.col("norm").alias(f"{c}_norm"), F.col("id").alias(f"{c}_id"))
    fit = rows.where((F.col("confidence") >= least) & F.col("predicate").isin(*predicates)).withColumn("source_norm", F.lower(F.trim("source"))).withColumn("target_norm", F.lower(F.trim("target")))
    return fit.join(end("source"), "source_norm").join(end("target"), "target_norm").select("source_id", "target_id", "predicate", "confidence")


def merged_relations(rows: DataFrame) -> DataFrame:
    """src, dst, rel_type, confidence (the greatest), description (the longest), chunks (all, sorted): one row for each relation."""
    return rows.groupBy("src", "dst", "rel_type").agg(
        F.max("confidence").alias("confidence"),
        F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), F.col("description"))).alias("description"),
        F.array_sort(F.collect_set("chunk")).alias("chunks"),
    )


def path_predicates(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """start, end, path, predicates of paths (start, end, path): each hop's least relation type, either way, joined by commas."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel_type"))
    kind = both.groupBy("a", "b").agg(F.min("rel_type").alias("rel_type"))
    hop = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i.cast("int")).alias("a"), F.element_at("path", (i + 1).cast("int")).alias("b")))
    hops = paths.where(F.size("path") > 1).select("start", "end", "path", F.posexplode(hop).alias("at", "hop")).select("start", "end", "path", "at", "hop.a", "hop.b")
    found = hops.join(kind, ["a", "b"]).groupBy("start", "end", "path").agg(F.array_sort(F.collect_list(F.struct("at", "rel_type"))).alias("found"))
    return found.select("start", "end", "path", F.array_join(F.transform("found", lambda x: x["rel_type"]), ",").alias("predicates"))


def impact(both: DataFrame, seeds: DataFrame, words: list[str]) -> DataFrame:
    """id, direct (neighbours), indirect (nodes two hops away), dependents (neighbours over a type with one of the words)."""
    near = both.join(seeds.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("a").alias("id"), F.col("b").alias("node"), any_field_contains_type(words).alias("depends"))
    first = near.groupBy("id", "node").agg(F.max("depends").alias("depends"))
    counts = first.groupBy("id").agg(F.count("*").alias("direct"), F.count_if("depends").alias("dependents"))
    far = first.select("id", F.col("node").alias("a")).join(both.select("a", "b").distinct(), "a").select("id", F.col("b").alias("node")).where("node != id").distinct()
    far = far.join(first.select("id", "node"), ["id", "node"], "left_anti").groupBy("id").agg(F.count("*").alias("indirect"))
    return counts.join(far, "id", "left").select("id", "direct", F.coalesce("indirect", F.lit(0)).cast("long").alias("indirect"), "dependents")


def any_field_contains_type(words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower("rel_type"), F.lit(w.lower())) for w in words))
