"""Quality metrics: distributions, coverage, precision and recall, percentiles, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """column, n, share of the total; the window runs over the few groups."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def confidence(groups: GroupedData, column: str, threshold: float) -> DataFrame:
    c = F.col(column)
    return groups.agg(
        F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.median(c), 6).alias("middle"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 6).alias("spread"),
        F.min(c).alias("low"), F.max(c).alias("high"), F.count_if(c < threshold).alias("below"),
    )


def precision_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of names without regard to case; both sides are made distinct first."""
    f = found.select(F.lower("name").alias("a")).distinct()
    t = truth.select(F.lower("name").alias("b")).distinct()
    met = f.join(t, F.col("a") == F.col("b"), "full")
    counts = met.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("tp"), F.count_if(F.col("b").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return counts.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(0.0001)), 6).alias("f1"))


def _whole(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals: entities, mean confidence, kinds, share with a description, relations, linked entities."""
    described = F.when(F.coalesce("description", F.lit("")) != "", 1.0).otherwise(0.0)
    e = nodes.agg(F.count("*").alias("entities"), F.avg("confidence").alias("conf"), F.countDistinct("type").alias("kinds"), F.avg(described).alias("described"))
    r = edges.agg(F.count("*").alias("relations"))
    linked = edges.select(F.col("src").alias("x")).unionByName(edges.select(F.col("dst").alias("x"))).distinct().agg(F.count("*").alias("linked"))
    return e.crossJoin(r).crossJoin(linked)


def score(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """0 to 100 by confidence 30, relations 25, kinds 15, descriptions 20, linked entities 10; and its level."""
    n = F.greatest("entities", F.lit(1))
    total = 30 * F.col("conf") + 25 * F.least(F.col("relations") / n, F.lit(1.0)) + 15 * F.least(F.col("kinds") / 5.0, F.lit(1.0)) + 20 * F.col("described") + 10 * F.col("linked") / n
    level = F.when(total >= 90, "excellent").when(total >= 75, "good").when(total >= 60, "fair").when(total >= 40, "poor").otherwise("critical")
    return _whole(nodes, edges).select(F.round(total, 4).alias("score"), level.alias("level"))


def anomalies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, value of each rule that fires."""
    whole = _whole(nodes, edges)
    largest = nodes.groupBy("type").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"))
    repeated = nodes.groupBy(F.lower("name"), "type").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated"))
    rules = [
        ("type_imbalance", "largest / entities", "largest / entities > 0.5"),
        ("low_confidence", "conf", "conf < 0.6"),
        ("missing_descriptions", "1 - described", "1 - described > 0.5"),
        ("no_relations", "0D", "relations = 0"),
        ("low_relation_ratio", "relations / entities", "relations > 0 and relations / entities < 0.1"),
        ("no_entities", "0D", "entities = 0"),
        ("duplicate_entities", "cast(repeated as double)", "repeated > 0"),
    ]
    rows = F.array(*(F.when(F.expr(when), F.struct(F.lit(kind).alias("kind"), F.round(F.expr(value).cast("double"), 6).alias("value"))) for kind, value, when in rules))
    return whole.crossJoin(largest).crossJoin(repeated).select(F.explode(F.array_compact(rows)).alias("r")).select("r.kind", "r.value")


#: A group's values are ranked in about so many pieces of equal weight, each sorted by itself.
PIECES = 64


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys that may be null; the keys come out once."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    on = None
    for c in keys:
        one = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        on = one if on is None else on & one
    return left.join(renamed, on).drop(*(f"_r_{c}" for c in keys))


def ranked(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, column, upto (rows of the group up to this value), n for each distinct value of each group.

    Equal values are counted first. Each group is cut at approximate quantiles into PIECES; the pieces' sums
    give each one's place, and only within a piece are values sorted, so no group is sorted in one task.
    """
    counts = rows.groupBy(*keys, column).agg(F.count("*").alias("c"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(column, [i / PIECES for i in range(1, PIECES)], 10 * PIECES).alias("cuts"))
    value = F.col(column)
    pieces = _same(counts, cuts, keys).withColumn("piece", F.coalesce(F.size(F.filter("cuts", lambda x: x < value)), F.lit(0))).drop("cuts")
    sums = pieces.groupBy(*keys, "piece").agg(F.sum("c").alias("s"))
    w = Window.partitionBy(*keys)
    places = sums.select(*keys, "piece", (F.sum("s").over(w.orderBy("piece")) - F.col("s")).alias("before"), F.sum("s").over(w).alias("n"))
    inner = Window.partitionBy(*keys, "piece").orderBy(column)
    return _same(pieces, places, [*keys, "piece"]).select(*keys, column, (F.col("before") + F.sum("c").over(inner)).alias("upto"), "n")


def latency(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Interpolated percentiles, with the other usual statistics; null values count in n alone."""
    c = F.col(column)
    percents = (50, 75, 90, 95, 99)
    plain = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.min(c), 6).alias("low"), F.round(F.max(c), 6).alias("high"), F.round(F.avg(c), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 6).alias("spread"),
    )
    at = lambda p: (F.col("n") - 1) * (p / 100)
    ends = [F.min(F.when(F.col("upto") > f(at(p)), c)).alias(f"{name}{p}") for p in percents for name, f in (("lo", F.floor), ("hi", F.ceil))]
    found = ranked(rows.where(c.isNotNull()), keys, column).groupBy(*keys).agg(F.max("n").alias("n"), *ends)
    part = lambda p: F.col(f"lo{p}") + (F.col(f"hi{p}") - F.col(f"lo{p}")) * (at(p) - F.floor(at(p)))
    found = found.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(F.round(part(p), 6).alias(f"p{p}") for p in percents))
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = one if on is None else on & one
    return plain.join(found, on, "left").drop(*(f"_r_{k}" for k in keys))


def index_percentiles(rows: DataFrame, keys: list[str], column: str, percents: tuple[int, ...], gates: tuple[int, ...] = ()) -> DataFrame:
    """sorted[int(n * p)] of each group, from counts of distinct values: no group is collected or sorted whole.

    A group of fewer values than a percentile's gate has its maximum.
    """
    out = []
    for i, p in enumerate(percents):
        at = F.least(F.col("n") - 1, F.floor(F.col("n") * (p / 100)))
        if gates:
            at = F.when(F.col("n") < gates[i], F.col("n") - 1).otherwise(at)
        out.append(F.min(F.when(F.col("upto") > at, F.col(column))).alias(f"p{p}"))
    found = ranked(rows, keys, column).groupBy(*keys).agg(F.max("n").alias("n"), *out)
    return found if gates else found.drop("n")


def hubs(both: DataFrame) -> DataFrame:
    """hub, degree, density of the graph: nodes of three neighbours and 1.5 times the mean at least."""
    degree = both.groupBy(F.col("a").alias("hub")).agg(F.countDistinct("b").alias("degree"))
    whole = degree.agg(F.avg("degree").alias("mean"), F.count("*").alias("n"), (F.sum("degree") / 2).alias("e"))
    density = F.round(F.col("e") / (F.col("n") * (F.col("n") - 1) / 2.0), 8)
    return degree.crossJoin(F.broadcast(whole)).where(F.col("degree") >= F.greatest(F.lit(3.0), 1.5 * F.col("mean"))).select("hub", "degree", density.alias("density"))


def top_per_group(rows: DataFrame, keys: list[str], value: str, tie: str, k: int) -> DataFrame:
    """The k rows of each group with the greatest values, with their rank as `pick`.

    Spark prunes each task's rows by the rank limit before the shuffle, so a hot group costs k rows a task.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    return rows.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k)


def counted(metrics: dict[str, DataFrame]) -> DataFrame:
    """metric, value: the number of rows of each table, each one aggregation."""
    out = None
    for name, rows in metrics.items():
        part = rows.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def document_checks(documents: DataFrame, most: int = 1_000_000, size: int = 1000, overlap: int = 200) -> DataFrame:
    """doc_id, fault (empty, too_large or null), chunks and entities to expect of each document."""
    n = F.length(F.coalesce("text", F.lit("")))
    blank = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    chunks = F.when(blank, 0).otherwise(F.greatest(F.lit(1), F.floor(n / F.lit(size)))).cast("long")
    return documents.select("doc_id", F.when(blank, "empty").when(n > most, "too_large").alias("fault"), chunks.alias("chunks"), (chunks * 5).alias("entities"))


def role_grants(parents: DataFrame, grants: DataFrame) -> DataFrame:
    """role, permission, effect: what each role has by itself and by inheritance (role, parent); a deny beats an allow, from wherever it comes."""
    from .graph import ancestors

    up = ancestors(parents.select(F.col("role").alias("id"), "parent")).select(F.col("id").alias("role"), F.col("ancestor").alias("owner"))
    own = grants.select("role", F.col("role").alias("owner")).distinct()
    rows = up.unionByName(own).distinct().join(grants.withColumnRenamed("role", "owner"), "owner")
    return rows.groupBy("role", "permission").agg(F.max("effect").alias("effect"))  # 'deny' is after 'allow'
