"""Ordered leader clustering of named entities: exact, fuzzy, embedding and cross-lingual stages.

In an order of their own, names join the first earlier leader that they match, by the first stage that has one, and lead
themselves if none does. No list of all similar pairs is made: names come in batches that grow, each is compared with
the leaders of those before, once, and only what is left of a batch with itself. As the order is that of a hash, a family of
similar names shows up while batches are small; what is compared grows with names times leaders that share a rare token,
not with the square of a family.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from .graph import cut

#: Names of the first batch, at most about; a batch has all names up to a hash, and the next one up to 2 ** GROWTH times that.
FIRST, GROWTH = 512, 2
#: Token frequencies that are known to the tasks; all rarer tokens count as equally rare.
KNOWN = 1 << 16
#: Leaders whose angles to vectors tell cells apart.
PIVOTS = 16


def tokens(norm: Column | str) -> Column:
    """The distinct pairs of neighbouring characters of a name, its ends marked."""
    t = F.concat(F.lit("^"), F.col(norm) if isinstance(norm, str) else norm, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))


def _least_shared(n: Column, share: float) -> Column:
    return F.ceil(n * share - 1e-9).cast("int")


def token_sets(names: DataFrame, group: str, name: str, share: float) -> DataFrame:
    """names with `size` of their token sets, `sorted` tokens by rising frequency in their group, and `prefix`: names of
    which `share` of the larger set's tokens are common have a token of both prefixes in common."""
    often = names.select(F.col(group).alias("g"), F.explode(tokens(name)).alias("t")).groupBy("g", "t").agg(F.count("*").alias("f"))
    places: dict[str, dict[str, int]] = {}
    for i, r in enumerate(reversed(often.orderBy(F.desc("f"), "g", "t").limit(KNOWN).collect())):
        places.setdefault(r.g, {})[r.t] = i

    @F.pandas_udf(ArrayType(StringType()))
    def by_frequency(groups: pd.Series, texts: pd.Series) -> pd.Series:
        def one(g, text):
            t, place = f"^{text}$", places.get(g, {})
            return sorted({t[i : i + 2] for i in range(len(t) - 1)}, key=lambda x: (place.get(x, -1), x))

        return pd.Series([one(g, text) for g, text in zip(groups, texts, strict=True)], dtype=object)

    size = F.size("sorted")
    return names.withColumn("sorted", by_frequency(group, name)).withColumn("size", size).withColumn("prefix", F.slice("sorted", F.lit(1), size - _least_shared(size, share) + 1))


def candidates(left: DataFrame, right: DataFrame, group: str, name: str, share: float) -> DataFrame:
    """group, x, y, x_rank, y_rank: pairs of names of token_sets that share enough of their tokens; a prefix-filtered join.

    A pair meets at each token that both prefixes have, and is made at the first of them alone.
    """
    side = lambda d, p: d.select(group, F.explode("prefix").alias("t"), *(F.col(c).alias(f"{p}_{c}") for c in ("rank", "size", "sorted", "prefix")), F.col(name).alias(p))
    larger, smaller = F.greatest("x_size", "y_size"), F.least("x_size", "y_size")
    met = side(left, "x").join(side(right, "y"), [group, "t"]).where(smaller >= _least_shared(larger, share))
    met = met.where(F.element_at(F.array_intersect("x_prefix", "y_prefix"), 1) == F.col("t"))
    return met.where(F.size(F.array_intersect("x_sorted", "y_sorted")) >= _least_shared(larger, share)).select(group, "x", "y", "x_rank", "y_rank")


def best_fuzzy(x: Column | str, y: Column | str) -> Column:
    """The greater of edit and Jaro-Winkler similarity of two normalised names."""
    return F.greatest(T.edit_similarity(x, y), T.jaro_winkler(x, y))


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x)) | ~(norm > 0) | (norm == float("inf"))
    return F.when(~bad, F.transform(v, lambda x: x / norm))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_candidates(left: DataFrame, right: DataFrame, group: str, name: str, least: float) -> DataFrame:
    """group, x, y, x_rank, y_rank, cosine of the pairs of unit vectors with a cosine of `least` or more.

    Right vectors lie in the cell of their nearest pivot. By the triangle inequality a left vector's partners are in
    cells whose pivot is at most two angles of `least` farther from it than its nearest one: only these are read.
    """
    left, right = (d.where("unit is not null") for d in (left, right))
    pivots = [r.unit for r in right.orderBy("rank", name).limit(PIVOTS).select("unit").collect()]
    angle = lambda p: F.when(F.size("unit") == len(p), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(F.col("unit"), F.array(*map(F.lit, p)))))))
    to = F.array(*(F.struct(F.coalesce(angle(p), F.lit(9.0)).alias("a"), F.lit(i).alias("cell")) for i, p in enumerate(pivots))) if pivots else F.array(F.struct(F.lit(9.0).alias("a"), F.lit(0).alias("cell")))
    far = 2 * math.acos(least) + 1e-6
    side = lambda d, p: d.select(group, F.col("dims"), "cell", F.col("rank").alias(f"{p}_rank"), F.col("unit").alias(f"{p}_unit"), F.col(name).alias(p))
    sized = lambda d: d.withColumn("dims", F.size("unit")).withColumn("to", to)
    homes = side(sized(right).withColumn("cell", F.array_min("to")["cell"]), "y")
    asks = side(sized(left).withColumn("cell", F.explode(F.filter("to", lambda s: s["a"] <= F.array_min("to")["a"] + far)["cell"])), "x")
    return asks.join(homes, [group, "dims", "cell"]).withColumn("cosine", _dot(F.col("x_unit"), F.col("y_unit"))).where(F.col("cosine") >= least).select(group, "x", "y", "x_rank", "y_rank", "cosine")


def first_independent(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """group, name: the nodes (group, name) that, taken in the order of their ranks, have no link to one taken before.

    links has group, x, y, x_rank, y_rank with x later than y. In each round the nodes without an open earlier
    neighbour are taken and what links to them goes.
    """
    out, left, links = None, nodes.select("grp", "name"), links.select("grp", "x", "y").distinct()
    while True:
        blocked = links.select("grp", F.col("x").alias("name")).distinct()
        free = cut(left.join(blocked, ["grp", "name"], "left_anti"))
        out = free if out is None else out.unionByName(free)
        gone = links.join(free.withColumnRenamed("name", "y"), ["grp", "y"], "left_semi").select("grp", F.col("x").alias("name")).distinct()
        left = cut(left.join(free, ["grp", "name"], "left_anti").join(gone, ["grp", "name"], "left_anti"))
        if left.isEmpty():
            return out
        keep = lambda d, c: d.join(left.withColumnRenamed("name", c), ["grp", c], "left_semi")
        links = cut(keep(keep(links, "x"), "y").select("grp", "x", "y"))


def leader_clusters(entities: DataFrame, vectors: DataFrame | None = None, fuzzy: float = 0.85, embedding: float = 0.90, cross_lingual: float = 0.88, share: float = 0.5) -> DataFrame:
    """id, cluster (the least id of the leader's name), stage of entities (id, type, name) with vectors (id, vector).

    Equal normalised names of a type are one name: its entity of the least id has its stage and vector, the others the
    stage `exact`. Names come in the order of the MD5 of type and name. A name joins the first leader of its type that
    its edit or Jaro-Winkler similarity (of names that share `share` of the larger one's character pairs) reaches; or
    else whose vector does; or else, at a lower cosine, whose name is in another script. Without a match it leads.

    A null name leads itself; null types are one type; entities without an id are left out. Null, zero and non-finite
    vectors match nothing.
    """
    rows = entities.where("id is not null").select("id", F.coalesce("type", F.lit("")).alias("grp"), T.normalize_name("name").alias("name"))
    names = rows.where("name is not null").groupBy("grp", "name").agg(F.min("id").alias("rep")).withColumn("rank", F.md5(F.concat("grp", F.lit(":"), "name")))
    if vectors is None:
        names = names.withColumn("unit", F.lit(None).cast("array<double>"))
    else:
        units = vectors.groupBy("id").agg(F.min(F.col("vector").cast("array<double>")).alias("v")).select(F.col("id").alias("rep"), _unit(F.col("v")).alias("unit"))
        names = names.join(units, "rep", "left")
    names = cut(token_sets(names, "grp", "name", share))
    total = names.count()
    lowest = min(embedding, cross_lingual)

    def fuzzy_links(left: DataFrame, right: DataFrame) -> DataFrame:
        found = candidates(left, right, "grp", "name", share).where("x_rank > y_rank")
        found = found.withColumn("close", 1 - F.levenshtein("x", "y") / F.greatest(F.length("x"), F.length("y"), F.lit(1)) >= fuzzy)
        jaro = T.jaro_winkler(*(F.when(~F.col("close"), F.col(c)) for c in "xy"))
        return found.withColumn("jaro", jaro).where(F.col("close") | (F.col("jaro") >= fuzzy)).select("grp", "x", "y", "y_rank", F.lit(2).alias("stage"))

    def vector_links(left: DataFrame, right: DataFrame) -> DataFrame:
        found = vector_candidates(left, right, "grp", "name", lowest).where("x_rank > y_rank")
        stage = F.when(F.col("cosine") >= embedding, 3).when((F.col("cosine") >= cross_lingual) & T.cross_lingual("x", "y"), 4)
        return found.withColumn("stage", stage).where("stage is not null").select("grp", "x", "y", "y_rank", "stage")

    def links_of(left: DataFrame, right: DataFrame) -> DataFrame:
        found = fuzzy_links(left, right)
        return found.unionByName(vector_links(left, right)) if vectors is not None else found

    def best(links: DataFrame) -> DataFrame:
        return links.groupBy("grp", "x").agg(F.min_by(F.struct("y", "y_rank", "stage"), F.struct("stage", "y_rank")).alias("to")).select("grp", "x", "to.*")

    def of(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
        return rows.join(keys.select("grp", F.col(key).alias("name")), ["grp", "name"], how)

    leaders, joined = None, []
    rounds = max(0, math.ceil(math.log2(max(1, total) / FIRST) / GROWTH))
    edge = lambda k: f"{(1 << 32) >> GROWTH * k:08x}" if k else "g"  # noqa: E731  hexadecimal digits come before g
    for k in range(rounds, -1, -1):
        left, near = names.where(F.col("rank") < edge(k)), None
        if leaders is not None:
            # Earlier leaders come before those of this batch, so that the first fuzzy match stays; one by vectors may still find a fuzzy one.
            left = left.where(F.col("rank") >= edge(k + 1))
            joined.append(cut(best(fuzzy_links(left, leaders))))
            left = cut(of(left, joined[-1], "x", "left_anti"))
            if vectors is not None:
                near = cut(best(vector_links(left, leaders)))
                late, left = of(left, near, "x", "left_semi"), of(left, near, "x", "left_anti")
        links = cut(links_of(left, left))
        new = first_independent(left, links)
        new = cut(of(left, new, "name", "left_semi"))
        joined.append(cut(best(links.join(new.select("grp", F.col("name").alias("y")), ["grp", "y"], "left_semi"))))
        if near is not None:
            joined.append(cut(best(links_of(late, new).unionByName(near))))
        leaders = new if leaders is None else leaders.unionByName(new)
    ends = leaders.select("grp", F.col("name").alias("x"), F.col("name").alias("y"), F.lit(0).alias("stage"))
    for j in joined:
        ends = ends.unionByName(j.select("grp", "x", "y", "stage"))
    own = leaders.select("grp", F.col("name").alias("y"), F.col("rep").alias("cluster"))
    named = ends.withColumnRenamed("x", "name").join(own, ["grp", "y"]).join(names.select("grp", "name", "rep"), ["grp", "name"])
    stages = F.when(F.col("stage").isNull() | (F.col("id") == F.col("rep")) & (F.col("stage") == 0), "leader").when(F.col("id") != F.col("rep"), "exact")
    stages = stages.when(F.col("stage") == 2, "fuzzy").when(F.col("stage") == 3, "embedding").otherwise("cross_lingual")
    return rows.join(named, ["grp", "name"], "left").select("id", F.coalesce("cluster", "id").alias("cluster"), stages.alias("stage"))
