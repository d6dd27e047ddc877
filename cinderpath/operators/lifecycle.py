"""Lifecycle of nodes and edges without a table format: each operator returns the new table, to be written and swapped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import reach


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], as_of) -> DataFrame:
    """Stored rows, overlaid by incoming ones; created_at stays, updated_at and version (plus one) move.

    stored has created_at, updated_at, version besides the columns of incoming. Incoming keys must be
    distinct: dedup them first (matching.first_by). Null incoming values keep what is stored.
    """
    values = [c for c in incoming.columns if c not in keys]
    new = incoming.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values), F.lit(True).alias("_touched"))
    now = F.lit(as_of)
    touched = F.coalesce("_touched", F.lit(False))
    return stored.join(new, keys, "full").select(
        *keys,
        *(F.coalesce(f"_new_{c}", c).alias(c) for c in values),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(touched, now).otherwise(F.col("updated_at")).alias("updated_at"),
        (F.coalesce("version", F.lit(0)) + touched.cast("int")).cast("int").alias("version"),
    )


def upsert_edges(stored: DataFrame, incoming: DataFrame, nodes: DataFrame, as_of) -> DataFrame:
    """As upsert by (src, dst, rel_type), of edges whose ends both exist."""
    ids = nodes.select("id")
    fit = incoming.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return upsert(stored, fit, ["src", "dst", "rel_type"], as_of)


def soft_delete(nodes: DataFrame, edges: DataFrame, ids: DataFrame, policy: str = "ORPHAN") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report) after a soft delete of ids; deleted edges get is_deleted.

    RESTRICT leaves a node that has an edge; CASCADE deletes the neighbours over one hop as well; ORPHAN and
    SET_NULL delete the node and mark its edges. report has id, outcome: deleted, restricted, already_deleted, not_found.
    """
    if policy not in ("CASCADE", "ORPHAN", "RESTRICT", "SET_NULL"):
        raise ValueError(f"unknown policy {policy}")
    gone = F.coalesce("is_deleted", F.lit(False))
    state = ids.select("id").distinct().join(nodes.select("id", gone.alias("gone")), "id", "left")
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct().withColumn("linked", F.lit(True))
    state = state.join(ends, "id", "left")
    outcome = F.when(F.col("gone").isNull(), "not_found").when(F.col("gone"), "already_deleted")
    if policy == "RESTRICT":
        outcome = outcome.when(F.col("linked"), "restricted")
    report = state.select("id", outcome.otherwise("deleted").alias("outcome"))
    hit = report.where("outcome = 'deleted'").select("id")
    if policy == "CASCADE":
        out = edges.join(hit.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        back = edges.join(hit.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
        hit = hit.unionByName(out).unionByName(back).distinct()
    marked = hit.withColumn("_hit", F.lit(True))
    columns = [c for c in nodes.columns if c != "is_deleted"]
    new_nodes = nodes.join(marked, "id", "left").select(*columns, F.coalesce("_hit", "is_deleted").alias("is_deleted"))
    src = marked.select(F.col("id").alias("src"), F.col("_hit").alias("_s"))
    dst = marked.select(F.col("id").alias("dst"), F.col("_hit").alias("_d"))
    new_edges = edges.join(src, "src", "left").join(dst, "dst", "left").select(
        *(c for c in edges.columns if c != "is_deleted"), F.coalesce("_s", "_d", F.col("is_deleted") if "is_deleted" in edges.columns else F.lit(False), F.lit(False)).alias("is_deleted")
    )
    return new_nodes, new_edges, report


def restore(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    marked = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    columns = [c for c in nodes.columns if c != "is_deleted"]
    return nodes.join(marked, "id", "left").select(*columns, F.when(F.col("_hit"), False).otherwise(F.col("is_deleted")).alias("is_deleted"))


def purge(nodes: DataFrame, edges: DataFrame, before) -> tuple[DataFrame, DataFrame]:
    """Nodes deleted before a time are removed with their edges."""
    dead = nodes.where(F.coalesce("is_deleted", F.lit(False)) & (F.col("deleted_at") < F.lit(before))).select("id")
    left = edges.join(dead.select(F.col("id").alias("src")), "src", "left_anti").join(dead.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(dead, "id", "left_anti"), left


def backfill(nodes: DataFrame, as_of) -> DataFrame:
    """Missing created_at, updated_at and version get defaults."""
    columns = [c for c in nodes.columns if c not in ("created_at", "updated_at", "version")]
    made = F.coalesce("created_at", F.lit(as_of))
    return nodes.select(*columns, made.alias("created_at"), F.coalesce("updated_at", "created_at", F.lit(as_of)).alias("updated_at"), F.coalesce("version", F.lit(1)).alias("version"))


def retry_queue(items: DataFrame, as_of, backoff_minutes: int = 5) -> DataFrame:
    """The dead-letter queue after one failed retry of each item that is due.

    items: id, status, retry_count, max_retries, next_retry (a timestamp). A due item's count grows; it is abandoned
    at its greatest number of retries, else due again after backoff * 2 ** count minutes.
    """
    due = (F.col("status") == "pending") & (F.coalesce("next_retry", F.lit(as_of)) <= F.lit(as_of))
    count = F.when(due, F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    status = F.when(due & (count >= F.col("max_retries")), "abandoned").otherwise(F.col("status"))
    wait = F.timestamp_add("MINUTE", (F.lit(backoff_minutes) * F.pow(F.lit(2), count)).cast("int"), F.lit(as_of))
    return items.select("id", status.alias("status"), count.alias("retry_count"), "max_retries", F.when(due & (count < F.col("max_retries")), wait).otherwise(F.col("next_retry")).alias("next_retry"))


def cascade(nodes: DataFrame, edges: DataFrame, ids: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after a soft delete of ids and of all nodes within so many undirected hops; then of the edges of all these."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    hit = reach(both, ids.select("id").distinct(), depth).select(F.col("node").alias("id")).distinct()
    new_nodes, new_edges, _ = soft_delete(nodes, edges, hit, "ORPHAN")
    return new_nodes, new_edges


def deleted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, n_edges of soft-deleted nodes."""
    gone = nodes.where(F.coalesce("is_deleted", F.lit(False))).select("id")
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).join(gone, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n_edges"))
    return gone.join(ends, "id", "left").select("id", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))


def touch(nodes: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Nodes with updated_at and version (plus one) moved for the ids."""
    marked = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    columns = [c for c in nodes.columns if c not in ("updated_at", "version")]
    hit = F.coalesce("_hit", F.lit(False))
    return nodes.join(marked, "id", "left").select(*columns, F.when(hit, F.lit(as_of)).otherwise(F.col("updated_at")).alias("updated_at"), (F.coalesce("version", F.lit(0)) + hit.cast("int")).alias("version"))


def outdated(vectors: DataFrame, current: str) -> DataFrame:
    """Rows whose embedding version is missing or another one."""
    return vectors.where(F.col("version").isNull() | (F.col("version") != current))


def migrated(vectors: DataFrame, done: DataFrame, current: str) -> DataFrame:
    """Vectors after new ones (id, embedding) took the place of the old, with the current version."""
    new = done.select("id", F.col("embedding").alias("_new"))
    columns = [c for c in vectors.columns if c not in ("embedding", "version")]
    return vectors.join(new, "id", "left").select(*columns, F.coalesce("_new", "embedding").alias("embedding"), F.when(F.col("_new").isNotNull(), current).otherwise(F.col("version")).alias("version"))
