"""Backup and restore of the node and edge tables: full and incremental exports, a manifest, retention."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "backup_id string, kind string, created_at timestamp, nodes long, edges long"


def export(nodes: DataFrame, edges: DataFrame, folder: str, backup_id: str, as_of: datetime.datetime, since: datetime.datetime | None = None) -> DataFrame:
    """Write nodes (changed since a time, if given) and edges below folder/backup_id; the manifest's row is returned and appended."""
    spark = nodes.sparkSession
    if since is not None:
        nodes = nodes.where(F.greatest(F.coalesce("updated_at", "created_at"), "created_at") > F.lit(since))
    nodes.write.mode("overwrite").parquet(f"{folder}/{backup_id}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/{backup_id}/edges")
    sizes = [spark.read.parquet(f"{folder}/{backup_id}/{t}").count() for t in ("nodes", "edges")]
    row = spark.createDataFrame([(backup_id, "full" if since is None else "incremental", as_of, *sizes)], MANIFEST)
    row.write.mode("append").parquet(f"{folder}/manifest")
    return row


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """backup_id, valid: whether the files hold as many rows as the manifest says."""
    out = None
    for row in manifest(spark, folder).toLocalIterator():  # one row a backup
        n = spark.read.parquet(f"{folder}/{row['backup_id']}/nodes").agg(F.count("*").alias("n"))
        e = spark.read.parquet(f"{folder}/{row['backup_id']}/edges").agg(F.count("*").alias("e"))
        one = n.crossJoin(e).select(F.lit(row["backup_id"]).alias("backup_id"), ((F.col("n") == row["nodes"]) & (F.col("e") == row["edges"])).alias("valid"))
        out = one if out is None else out.unionByName(one)
    return out


def expired(backups: DataFrame, as_of: datetime.datetime, days: int, keep: int) -> DataFrame:
    """Backups past the retention, or beyond the newest so many."""
    rank = F.row_number().over(Window.orderBy(F.desc("created_at"), "backup_id"))
    rows = backups.withColumn("rank", rank)
    return rows.where((F.col("created_at") < F.lit(as_of - datetime.timedelta(days=days))) | (F.col("rank") > keep)).drop("rank")


def restore(spark: SparkSession, folder: str, backup_id: str, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (of some types) and the edges between them."""
    nodes = spark.read.parquet(f"{folder}/{backup_id}/nodes")
    edges = spark.read.parquet(f"{folder}/{backup_id}/edges")
    if types is not None:
        nodes = nodes.where(F.col("type").isin(types))
        edges = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, edges
