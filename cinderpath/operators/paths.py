"""The best paths between topics, and evidence from paths, edges, descriptions, chunks, communities and query rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


#: Labels a pair that a first search follows; a pair that needs more is searched again with four times as many.
WIDTH = 16
#: Links at either end of a node's order that are looked at before all of them.
EDGE = 16


def _ranked(links: DataFrame) -> DataFrame:
    """a, b, r (the place of b among a's links, in their order), n (how many these are)."""
    of = Window.partitionBy("a")
    return links.withColumn("r", F.row_number().over(of.orderBy("b"))).withColumn("n", F.count("*").over(of))


def _before(links: DataFrame, back: DataFrame | None, ends: DataFrame) -> DataFrame:
    """end, node, low, high: nodes a step further from an end than those of `back`, with the least and the greatest next
    node of a walk that never turns straight back nor meets its end before. Two are enough to avoid any one node.

    A node's first and last EDGE links (of `_ranked`) are looked at: what is found among both is the least and the greatest.
    All links are looked at of nodes for which these don't tell of every end."""
    if back is None:
        return ends.select("end", F.col("end").alias("node"), F.lit(None).cast(ends.schema["end"].dataType).alias("low"), F.col("end").alias("high"))

    def walked(some: DataFrame) -> DataFrame:
        rows = some.join(back.withColumnRenamed("node", "b"), "b").where("a <> end and (low is null or low <> a or high <> a)")
        return rows.groupBy("end", F.col("a").alias("node")).agg(F.min("b").alias("low"), F.max("b").alias("high"), F.min("r").alias("first"), F.max("r").alias("last"), F.first("n").alias("n"))

    few = cut(walked(links.where((F.col("r") <= EDGE) | (F.col("r") > F.col("n") - EDGE))))
    whole = F.col("n") <= 2 * EDGE
    told = few.where(~whole & (F.col("first") <= EDGE) & (F.col("last") > F.col("n") - EDGE)).unionByName(ends.select("end", F.col("end").alias("node")), allowMissingColumns=True)
    told = cut(told.groupBy("node").agg(F.count("*").alias("c")).where(F.col("c") == ends.count()).select("node"))
    rest = links.where(~whole).join(told.withColumnRenamed("node", "a"), "a", "left_anti")
    columns = ["end", "node", "low", "high"]
    return few.where(whole).select(columns).unionByName(few.where(~whole).join(told, "node", "left_semi").select(columns)).unionByName(walked(rest).select(columns))


def best_paths(both: DataFrame, pairs: DataFrame, k: int = 3, hops: int = 5) -> DataFrame:
    """start, end, pick, path: the first k paths without a repeated node of each pair, the shortest first, then by their nodes.

    Each length is searched in turn, for the pairs that have fewer than k paths. Labels (start, end, node, path) grow by
    a hop a round, only to nodes that a walk of just the hops left joins with the end; of a pair the WIDTH least go on.
    What is dropped is greater than all that is kept, so that k paths of those kept are the best; a pair that gets fewer
    after a drop is searched again with more labels, all of them in the end: the result is that of listing all paths.
    """
    links = cut(_ranked(both.select("a", "b").where("a <> b").distinct()))
    open_ = cut(pairs.select("start", "end").where("start <> end").distinct().withColumn("n", F.lit(0)))
    order = Window.partitionBy("start", "end").orderBy("path")
    ends = cut(open_.select("end").distinct())
    backs: list[DataFrame] = []
    found = None
    for d in range(1, hops + 1):
        backs.append(cut(_before(links, backs[-1] if backs else None, ends)))
        todo, width, all_got = open_, max(WIDTH, k), None
        while True:
            front = todo.select("start", "end", F.col("start").alias("a"), F.array("start").alias("path"))
            short = None
            for left in range(d - 1, -1, -1):
                on = backs[left].withColumnRenamed("node", "b")
                step = front.join(links.select("a", "b"), "a").where(~F.array_contains("path", F.col("b"))).join(on, ["end", "b"])
                step = step.where("low is null or low <> a or high <> a").select("start", "end", F.col("b").alias("a"), F.concat("path", F.array("b")).alias("path"))
                kept = cut(step.withColumn("r", F.row_number().over(order)).where(F.col("r") <= width + 1))
                front = kept.where(F.col("r") <= width)
                more = kept.where(F.col("r") > width).select("start", "end")
                short = more if short is None else short.unionByName(more)
            got = cut(front.join(todo, ["start", "end"]).where(F.col("r") <= k - F.col("n")).select("start", "end", (F.col("n") + F.col("r")).alias("pick"), "path"))
            best = got.groupBy("start", "end").agg(F.max("pick").alias("m"))
            again = todo.join(short.distinct(), ["start", "end"], "left_semi").join(best.where(F.col("m") >= k), ["start", "end"], "left_anti")
            todo = cut(again)
            got = got.join(todo, ["start", "end"], "left_anti")
            all_got = got if all_got is None else all_got.unionByName(got)
            if todo.isEmpty():
                break
            width *= 4
        found = all_got if found is None else found.unionByName(all_got)
        done = all_got.groupBy("start", "end").agg(F.max("pick").alias("m"))
        open_ = cut(open_.join(done, ["start", "end"], "left").select("start", "end", F.coalesce("m", "n").alias("n")).where(F.col("n") < k))
        if d < hops and open_.isEmpty():
            break
    return found


def evidence_id(content: Column) -> Column:
    return F.concat(F.lit("ev_"), F.substring(F.sha2(content, 256), 1, 12))


def _clamped(score: Column | str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(score) if isinstance(score, str) else score))


def _evidence(rows: DataFrame, key: Column, kind: str, content: Column, score: Column, hop: Column, length: Column, named: Column | None = None) -> DataFrame:
    """named is what the id is made of, where that isn't the content."""
    whole = evidence_id(content if named is None else named)
    return rows.select(whole.alias("id"), content.alias("content"), F.lit(kind).alias("kind"), _clamped(score).alias("score"), hop.cast("int").alias("hop"), length.cast("int").alias("length"), key.alias("key"))


def path_evidence(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence of paths (start, end, pick, path): names and predicates in order, the nodes' mean relevance less a tenth a hop, by half at most.

    nodes: id, name, relevance. edges: src, dst, predicate; between two nodes the least predicate counts, in either direction.
    """
    steps = paths.select("start", "end", "pick", F.posexplode("path").alias("i", "node"), F.size("path").alias("size"), "path")
    steps = steps.withColumn("next", F.try_element_at("path", F.col("i") + 2)).drop("path")
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "predicate").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("next"), "predicate"))
    walked = steps.where("next is not null").select("node", "next").distinct()
    kinds = both.join(walked, ["node", "next"], "left_semi").groupBy("node", "next").agg(F.min("predicate").alias("predicate"))
    named = steps.join(nodes.select(F.col("id").alias("node"), "name", "relevance"), "node", "left").join(kinds, ["node", "next"], "left")
    part = F.concat(F.coalesce("name", "node"), F.when(F.col("next").isNotNull(), F.concat(F.lit(" →["), F.coalesce("predicate", F.lit("UNKNOWN")), F.lit("]→ "))).otherwise(F.lit("")))
    whole = named.groupBy("start", "end", "pick").agg(F.array_sort(F.collect_list(F.struct("i", part.alias("t")))).alias("parts"), (F.coalesce(F.sum("relevance"), F.lit(0.0)) / F.first("size")).alias("mean"), (F.first("size") - 1).alias("length"))
    content = F.array_join(F.transform("parts", lambda p: p["t"]), "")
    score = F.col("mean") * F.greatest(F.lit(0.5), 1.0 - (F.col("length") - 1) * 0.1)
    name = F.concat_ws("_", F.lit("path"), "start", "end", (F.col("pick") - 1).cast("string"), content)
    return _evidence(whole, F.concat_ws("|", "start", "end", "pick"), "PATH", F.concat(F.lit("[Reasoning Path] "), content), score, F.lit(0), F.col("length"), name)


def edge_evidence(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Direct evidence of edges whose ends are both known: the lesser relevance, the nearer end's distance."""
    side = lambda p: nodes.select(F.col("id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("name", "relevance", "distance")))
    rows = edges.join(side("src"), "src").join(side("dst"), "dst")
    content = F.concat_ws(" ", "src_name", "predicate", "dst_name")
    return _evidence(rows, F.concat_ws("|", "src", "dst", "predicate"), "DIRECT", content, F.least("src_relevance", "dst_relevance"), F.least("src_distance", "dst_distance"), F.lit(1))


def description_evidence(nodes: DataFrame) -> DataFrame:
    return _evidence(nodes.where("description <> ''"), F.col("id"), "DIRECT", F.concat_ws(": ", "name", "description"), F.col("relevance"), F.col("distance"), F.lit(0))


def chunk_evidence(hits: DataFrame) -> DataFrame:
    """Contextual evidence of found chunks (id, text, score): the first 500 characters; without a score, 0.5."""
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.5))
    return _evidence(hits.where("text <> ''"), F.col("id"), "CONTEXTUAL", F.substring("text", 1, 500), score, F.lit(0), F.lit(0))


def entity_evidence(hits: DataFrame) -> DataFrame:
    """Direct evidence of found entities (id, name, description, score)."""
    text = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.coalesce("name", F.lit("")), F.lit(": "), F.col("description"))).otherwise(F.coalesce("name", F.lit("")))
    rows = hits.withColumn("_t", text).where("_t <> ''")
    return _evidence(rows, F.col("id"), "DIRECT", F.substring("_t", 1, 500), F.coalesce(F.col("score").cast("double"), F.lit(0.5)), F.lit(0), F.lit(0), F.col("_t"))


def community_evidence(communities: DataFrame) -> DataFrame:
    """Evidence of communities (id, summary, score): a hop away."""
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.5))
    content = F.concat(F.lit("[Community Context] "), F.substring("summary", 1, 500))
    return _evidence(communities.where("summary <> ''"), F.col("id"), "COMMUNITY", content, score, F.lit(1), F.lit(0), F.col("summary"))


def row_evidence(rows: DataFrame, columns: list[str], hidden: tuple[str, ...] = ("id", "embedding", "chunk_embedding", "entity_embedding")) -> DataFrame:
    """Direct evidence of a query's rows (id, score and columns): `name: value` of what isn't null, empty, zero or hidden, long values cut."""
    parts = []
    for c in (c for c in columns if c not in hidden):
        v = F.col(c).cast("string")
        kind = dict(rows.dtypes)[c]
        if kind == "string":
            v = F.when(F.length(v) > 200, F.concat(F.substring(v, 1, 200), F.lit("..."))).otherwise(v)
            says = v != ""
        else:
            says = F.col(c) if kind == "boolean" else F.col(c) != 0
        parts.append(F.when(says, F.concat(F.lit(f"{c}: "), v)))
    text = F.concat(F.lit("[Query Result] "), F.concat_ws("; ", *parts))
    known = reduce(lambda a, b: a | b, (p.isNotNull() for p in parts))
    return _evidence(rows.where(known), F.col("id"), "DIRECT", F.substring(text, 1, 500), F.coalesce(F.col("score").cast("double"), F.lit(0.7)), F.lit(0), F.lit(0), text)


def first_of_producers(producers: list[DataFrame], most: int | None = None) -> DataFrame:
    """id, producer, content, kind, score, hop, length: the rows of all producers, the first producer's first row of an id winning; `most` in order of producers."""
    rows = reduce(DataFrame.unionByName, (p.withColumn("producer", F.lit(i + 1)) for i, p in enumerate(producers)))
    best = rows.groupBy("id").agg(F.min_by(F.struct("producer", "content", "kind", "score", "hop", "length", "key"), F.struct("producer", "key", "content")).alias("e")).select("id", "e.*")
    if most is not None:
        best = best.orderBy("producer", "key", "id").limit(most)
    return best.drop("key")
