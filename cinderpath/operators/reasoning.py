"""Evidence lists and reasoning chains: merging, provenance, gates, evaluation and confidence.

Evidence has id, score and further columns; chains have chain, step and the evidence that a step rests on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import first_by

# What a source's answers are worth, and risk levels.
SOURCES = {"GRAPH_ONLY": 1.0, "GRAPH_PRIMARY": 0.95, "LLM_SUPPLEMENTED": 0.85, "LLM_ONLY": 0.7}
LOW, MEDIUM, HIGH = "LOW", "MEDIUM", "HIGH"


def merge_lists(lists: list[DataFrame], most: int = 30) -> DataFrame:
    """Rows of several lists with equal columns, the first list's row of an id winning; the best by score."""
    rows = None
    for i, part in enumerate(lists):
        part = part.withColumn("_list", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    return first_by(rows, ["id"], ["_list"]).drop("_list").orderBy(F.desc("score"), "id").limit(most)


def provenance(evidence: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """The best few of each hop, primary from a score of 0.7 on, else supporting; pick is the rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    role = F.when(F.col("score") >= 0.7, "primary").otherwise("supporting")
    return evidence.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= most).withColumn("role", role)


def round_robin(evidence: DataFrame, kind: str, priority: Column, most: int) -> DataFrame:
    """One of each kind in turn, kinds by priority, the best of a kind first; place counts from 1.

    Each kind is cut to `most` before the last sort, so that sort sees few rows.
    """
    w = Window.partitionBy(kind).orderBy(F.desc("score"), "id")
    few = evidence.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= most).withColumn("_p", priority)
    few = few.orderBy("turn", "_p", kind).limit(most)
    return few.withColumn("place", F.row_number().over(Window.orderBy("turn", "_p", kind))).drop("_p")


def gate(evidence: DataFrame, keys: list[str], fuzzy: str) -> DataFrame:
    """keys, verdict: NO_DATA if no score reaches 0.3, or 0.5 where all of it is from fuzzy matches; else OK."""
    whole = evidence.groupBy(*keys).agg(F.max("score").alias("best"), F.bool_and(fuzzy).alias("all_fuzzy"))
    bad = (F.col("best") < 0.3) | (F.col("all_fuzzy") & (F.col("best") < 0.5))
    return whole.select(*keys, F.when(bad, "NO_DATA").otherwise("OK").alias("verdict"))


def evaluation(evidence: DataFrame, keys: list[str], completeness: Column, needed: int = 10) -> DataFrame:
    """keys, n, coverage (of `needed` rows), convergence (the mean of the five best), sufficiency (the mean of both, the given
    completeness and a consistency of 0.8) and the action that follows from them."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    rows = evidence.withColumn("_r", F.row_number().over(w)).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(F.col("_r") <= 5, F.col("score"))).alias("convergence"))
    coverage = F.least(F.col("n") / F.lit(float(needed)), F.lit(1.0))
    mean = (completeness + coverage + 0.8 + F.col("convergence")) / 4
    action = F.when(mean >= 0.8, "FINALIZE").when(coverage < 0.5, "RETRIEVE_MORE").when(completeness < 0.8, "CONTINUE_CHAIN").otherwise("RE_RANK_EVIDENCE")
    return rows.select(*keys, "n", F.round(coverage, 6).alias("coverage"), F.round("convergence", 6).alias("convergence"), F.round(mean, 6).alias("sufficiency"), action.alias("action"))


def chain_quality(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, direct and path (shares of the kinds DIRECT and PATH), relevance (the mean score), hops (different hops of PATH rows), farthest.

    One aggregation; a hot chain combines before it shuffles.
    """
    is_path = F.col("kind") == "PATH"
    hop = F.when(is_path, F.col("hop"))
    return evidence.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("kind") == "DIRECT", 1.0).otherwise(0.0)).alias("direct"), F.avg(F.when(is_path, 1.0).otherwise(0.0)).alias("path"),
        F.avg("score").alias("relevance"), F.countDistinct(hop).alias("hops"), F.max(hop).alias("farthest"),
    )


def path_completeness(quality: DataFrame, connected: Column, bridges: Column, longest: Column) -> Column:
    """0 to 1 for multi-hop questions, from chain_quality's columns and the subgraph's connectedness, bridges and longest path."""
    covered = F.when(F.coalesce("farthest", F.lit(0)) > 0, F.col("hops") / (F.col("farthest") + 1)).otherwise(0.0)
    parts = 0.25 * F.col("path") + 0.20 * F.when(connected, 1.0).otherwise(0.5) + 0.20 * F.when(bridges == 0, 0.3).otherwise(1.0) + 0.15 * F.least(F.lit(1.0), longest / 3.0) + 0.20 * covered
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), parts))


def final_confidence(base: Column, progress: Column, multi_hop: bool, completeness: Column | None = None, subgraph: Column | None = None) -> Column:
    """An answer's confidence from its base, the share of steps that made progress, and chain_quality's columns.

    A multi-hop answer counts path rows, completeness and the subgraph's quality (1 is neutral), and has 0.65 at most without path rows.
    """
    if not multi_hop:
        total = base * 0.50 + F.col("direct") * 0.20 + F.col("relevance") * 0.20 + progress * 0.10
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    covered = F.when(F.col("path") == 0, 1.0).when(F.col("farthest") > 0, F.col("hops") / (F.col("farthest") + 1)).otherwise(0.5)
    total = base * 0.35 + (F.col("path") * 0.6 + F.col("direct") * 0.4) * 0.15 + F.col("relevance") * 0.15 + completeness * 0.15 + covered * 0.10 + progress * 0.05 + (subgraph - 1.0) * 0.05
    return F.greatest(F.lit(0.0), F.least(F.when(F.col("path") == 0, 0.65).otherwise(1.0), total))


def chain_members(steps: DataFrame) -> DataFrame:
    """chain, evidence: the ids of each chain's evidence in the order of steps, joined by commas; a chain is as long as its question needs."""
    return steps.groupBy("chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "evidence"))), lambda s: s["evidence"].cast("string")), ",").alias("evidence"))


def chain_status(steps: DataFrame, evidence: DataFrame) -> DataFrame:
    """chain, steps, missing (steps without known evidence), repeated (queries asked more than once), status.

    INVALID where a query is repeated or fewer than half of the steps have evidence, VALID where all have.
    """
    known = evidence.select(F.col("id").alias("evidence"), F.lit(True).alias("known"))
    missing = steps.join(known, "evidence", "left").groupBy("chain").agg(F.count("*").alias("steps"), F.count_if(F.col("known").isNull()).alias("missing"))
    repeated = steps.groupBy("chain", "query").agg(F.count("*").alias("c")).where("c > 1").groupBy("chain").agg(F.count("*").alias("repeated"))
    rows = missing.join(repeated, "chain", "left").select("chain", "steps", "missing", F.coalesce("repeated", F.lit(0)).cast("long").alias("repeated"))
    status = F.when(F.col("repeated") > 0, "INVALID").when(F.col("missing") == 0, "VALID").when((F.col("steps") - F.col("missing")) * 2 >= F.col("steps"), "PARTIAL").otherwise("INVALID")
    return rows.withColumn("status", status)


def path_relevance(relevance: Column, hops: Column) -> Column:
    """The mean relevance of a path's nodes, less a tenth for each hop after the first, by half at most."""
    return relevance * F.greatest(F.lit(0.5), 1 - 0.1 * (hops - 1))


def source_multiplier(source: Column) -> Column:
    out = None
    for name, value in SOURCES.items():
        out = F.when(source == name, value) if out is None else out.when(source == name, value)
    return out.otherwise(0.8)


def hallucination_risk(source: Column, explicit: Column) -> Column:
    """LOW for answers from the graph, MEDIUM for supplemented ones, HIGH for others; the share of explicit evidence moves the first two."""
    base = F.when(source.isin("GRAPH_ONLY", "GRAPH_PRIMARY"), LOW).when(source == "LLM_SUPPLEMENTED", MEDIUM).otherwise(HIGH)
    return F.when((base == MEDIUM) & (explicit >= 0.5), LOW).when((base == LOW) & (explicit < 0.2), MEDIUM).otherwise(base)


def intervals_meet(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two closed intervals share a day."""
    return (a0 <= b1) & (b0 <= a1)


def years_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b)) / 365.25


def backoff(base: Column, attempt: Column, most: Column) -> Column:
    """Seconds to wait before an attempt: doubled each time, up to a bound."""
    return F.least(base * F.pow(F.lit(2.0), attempt), most)
