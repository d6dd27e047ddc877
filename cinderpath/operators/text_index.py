"""A written inverted index with block maxima, and top-k text search over it by thresholds, in Spark alone.

Postings of a term are cut into blocks by a hash of the document, each with the greatest impact in it. Texts are shuffled
once, to the blocks of their documents, and indexed there; a file has some blocks, sorted by term. A search first reads, for each query and term, the
blocks with the greatest impacts: what a document has from these bounds the k-th score from below. Then it reads the
blocks that can still hold a better document, and of the others only those in which such a candidate lies. Queries,
thresholds and candidates stay on the executors. Postings that it reads are shuffled once, by block and not by query, and
summed up where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import cut
from .quality import top_per_group
from .search import tokens

#: Documents of a label per hash group, about: a term's block has at most about as many postings.
BLOCK = 128
#: Blocks of each term of a query that are read for its threshold, in all.
FIRST_BLOCKS = 2
#: Blocks that a search brings together.
SHARD = 32
#: Slack for scores that are rounded to six places.
SLACK = 1e-5


@dataclass
class Index:
    """blocks: label, term, block, n, top (greatest impact), postings (id, impact). terms: label, term, df. labels: label, n, mean."""

    blocks: DataFrame
    terms: DataFrame
    labels: DataFrame


def write_index(documents: DataFrame, path: str, k1: float = 1.2, b: float = 0.75) -> Index:
    """Index documents (label, id, text) below a path.

    A posting's impact is tf (k1 + 1) / (tf + k1 (1 - b + b l / mean)), l being the document's words. Rows without a
    label or an id are left out; null texts have no words and count in n and mean; rows that repeat an id add up.
    """
    spark = documents.sparkSession
    docs = documents.where("label is not null and id is not null").select("label", "id", "text")
    size = F.size(tokens(F.col("text")))
    labels = docs.groupBy("label").agg(F.countDistinct("id").alias("n"), F.sum(size).alias("total")).select("label", "n", (F.col("total") / F.col("n")).alias("mean"), F.ceil(F.col("n") / BLOCK).alias("groups"))
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    labels = spark.read.parquet(f"{path}/labels")  # a row for each label
    # All that follows groups by block, and more, so that nothing but this shuffles. (A label may be a literal, which no grouping keeps.)
    placed = docs.join(F.broadcast(labels), "label").select("label", F.pmod(F.xxhash64("id"), F.col("groups")).alias("block"), "id", "text", "mean").repartition("block")
    words = F.flatten(F.transform(F.collect_list("text"), tokens))
    whole = placed.groupBy("label", "block", "id", "mean").agg(words.alias("words"))
    tf = whole.select("label", "block", "id", "mean", F.size("words").alias("l"), F.explode("words").alias("term")).groupBy("label", "block", "id", "mean", "l", "term").agg(F.count("*").alias("tf"))
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("l") / F.col("mean")))
    rows = tf.select("label", "term", "id", "block", impact.alias("impact"))
    blocks = rows.groupBy("label", "term", "block").agg(F.count("*").alias("n"), F.max("impact").alias("top"), F.collect_list(F.struct("id", "impact")).alias("postings"))
    blocks.sortWithinPartitions("label", "term", "block").write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/blocks").groupBy("label", "term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("blocks", "terms", "labels")))


@dataclass
class Found:
    """rows: query_id, label, id, score, pick; read: label, term, block, n of the blocks read, each once."""

    rows: DataFrame
    read: DataFrame


def search(index: Index, queries: DataFrame, k: int, least: float = 0.0) -> Found:
    """For each of queries (query_id, label, text) the k documents of that label with the greatest BM25 scores, rounded to six places, above `least`.

    The rows are those of scoring every posting of the queries' words. Equal scores rank by id. Null ids and labels ask nothing.
    """
    conf, name = queries.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    was = conf.get(name)
    conf.set(name, "false")  # joins by shard and more stay where the shards are
    try:
        return _search(index, queries, k, least)
    finally:
        conf.set(name, was)


def _search(index: Index, queries: DataFrame, k: int, least: float) -> Found:
    asked = queries.where("query_id is not null and label is not null").select("query_id", "label", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(index.terms, ["label", "term"]).join(F.broadcast(index.labels.select("label", "n")), "label").select("query_id", "label", "term", idf.alias("idf"))
    known = cut(known)
    key, of = ["label", "term", "block"], ["query_id", "label"]
    # The directory: which blocks there are and their maxima; postings aren't read.
    directory = cut(known.join(index.blocks.select(*key, "n", "top"), ["label", "term"]).select(*of, "term", "block", "n", "idf", (F.col("top") * F.col("idf")).alias("bound")))

    def scores(wanted: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
        """query_id, label, id, score a posting, of wanted (query_id, label, term, block, idf), and the key."""
        return wanted.join(blocks, key).select(*of, *(c for c in key if c not in of), "idf", F.explode("postings").alias("p")).select(*of, *(c for c in key if c not in of), F.col("p.id").alias("id"), (F.col("p.impact") * F.col("idf")).alias("s"))

    def sums(wanted: DataFrame) -> DataFrame:
        """query_id, label, shard, id, score of all postings in wanted blocks; each posting is shuffled once, whatever asks for it."""
        sharded = lambda d: d.withColumn("shard", F.floor(F.col("block") / SHARD)).repartition("shard")
        blocks = index.blocks.select(*key, "postings").join(known.select("label", "term").distinct(), ["label", "term"], "left_semi")
        return scores(sharded(wanted).hint("shuffle_hash"), sharded(blocks), [*key, "shard"]).groupBy(*of, "shard", "id").agg(F.sum("s").alias("s"))

    best = Window.partitionBy(*of, "term").orderBy(F.desc("bound"), "block")
    first = cut(directory.withColumn("r", F.row_number().over(best)).where(F.col("r") <= FIRST_BLOCKS).drop("r"))
    partial = scores(first, index.blocks.select(*key, "postings"), key).groupBy(*of, "id").agg(F.sum("s").alias("s"))
    kth = top_per_group(partial, of, "s", "id", k).where(F.col("pick") == k).select(*of, F.col("s").alias("kth"))
    # Terms by their bounds: those whose bounds together stay below the threshold can't lift a document above it.
    tops = directory.groupBy(*of, "term").agg(F.max("bound").alias("max"))
    run = Window.partitionBy(*of).orderBy("max", "term").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*of)
    terms = tops.join(kth, of, "left").withColumn("threshold", F.greatest(F.coalesce("kth", F.lit(0.0)), F.lit(float(least))) - SLACK).withColumn("below", F.sum("max").over(run)).withColumn("sum", F.sum("max").over(whole))
    terms = cut(terms.select(*of, "term", "max", "sum", "threshold", (F.col("below") < F.col("threshold")).alias("idle")))
    placed = directory.join(terms, [*of, "term"])
    # What a document of a hash group can reach: each term's own maximum there.
    group = Window.partitionBy(*of, "block")
    placed = cut(placed.withColumn("reach", F.sum("bound").over(group)).where(F.col("reach") >= F.col("threshold")))
    live = placed.where(~F.col("idle"))
    got = sums(live.select(*of, "term", "block", "idf"))
    left = terms.groupBy(*of).agg(F.sum(F.when(F.col("idle"), F.col("max")).otherwise(0.0)).alias("more"), F.first("threshold").alias("threshold"))
    candidates = cut(got.join(left, of).where(F.col("s") + F.col("more") >= F.col("threshold")).select(*of, "shard", "id", "s"))
    groups = F.broadcast(index.labels.select("label", "groups"))
    homes = candidates.join(groups, "label").select(*of, F.pmod(F.xxhash64("id"), F.col("groups")).alias("block")).distinct()
    rest = cut(placed.where("idle").join(homes, [*of, "block"], "left_semi").select(*of, "term", "block", "idf"))
    more = sums(rest).withColumnRenamed("s", "more")
    total = candidates.repartition("shard").join(more, [*of, "shard", "id"], "left").select(*of, "id", F.round(F.col("s") + F.coalesce("more", F.lit(0.0)), 6).alias("score"))
    total = cut(total.where((F.col("score") > 0) & (F.col("score") >= least)).transform(lambda d: top_per_group(d, of, "score", "id", k)))
    read = first.select(*key).unionByName(live.select(*key)).unionByName(rest.select(*key)).distinct().join(directory.select(*key, "n").distinct(), key)
    return Found(total, read)


def search_all(index: Index, queries: DataFrame, k: int, labels: list[str]) -> DataFrame:
    """query_id, label, id, score, pick: the k best of all labels for queries (query_id, text), from each label k / labels + 2 at most, or five.

    An id found under several labels counts by its best score; equal scores rank by label and id.
    """
    each = max(k // len(labels) + 2, 5)
    rows = search(index, queries.select("query_id", "text", F.explode(F.array(*map(F.lit, labels))).alias("label")), each).rows.drop("pick")
    once = rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "label"))).where("r = 1").drop("r")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "label", "id")
    return once.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k)


def community_search(index: Index, queries: DataFrame, members: DataFrame, subgraphs: DataFrame, k: int = 5, label: str = "Community", least: float = 0.5, entities: int = 10, connected: Column | float = 0.7) -> DataFrame:
    """query_id, id, score, source: the communities found by text from a score of `least` on, and those of a query's entities.

    members: id, community. subgraphs: query_id, id, place: the first `entities` ids of a query's subgraph count. At most k
    connected communities (by id) come at a score of their own, unless the text found them.
    """
    found = search(index, queries.withColumn("label", F.lit(label)), k, least).rows.select("query_id", "id", "score", F.lit("community_search").alias("source"))
    few = subgraphs.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "id"))).where(F.col("r") <= entities)
    near = few.join(members, "id").select("query_id", F.col("community").alias("id")).distinct()
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where(F.col("r") <= k).drop("r")
    near = near.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return found.unionByName(near.select("query_id", "id", (F.lit(connected) if isinstance(connected, float) else connected).alias("score"), F.lit("connected_community").alias("source")))
