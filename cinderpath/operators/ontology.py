"""Ontology: base types and predicates, constraints (end types, cardinality, uniqueness), inference and validation. Rule tables are a schema's size and are broadcast by Spark while small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import cut, hierarchy_faults


def type_violations(edges: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """rel_type, n, bad_source, bad_target of the edges of ruled types; a null type allows any."""
    a = nodes.select(F.col("id").alias("src"), F.col("type").alias("a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("type").alias("b"))
    rows = edges.select("src", "dst", "rel_type").join(rules.select("rel_type", "source_type", "target_type"), "rel_type").join(a, "src").join(b, "dst")
    return rows.groupBy("rel_type").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("source_type")).alias("bad_source"), F.count_if(F.col("b") != F.col("target_type")).alias("bad_target"))


def cardinality_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """rel_type, id, fault, n: targets with several sources where one is allowed, and the reverse."""
    # Rules are broadcast: a shuffle by rel_type would bring all edges of a type to one task.
    rows = edges.select("src", "dst", "rel_type").join(F.broadcast(rules.select("rel_type", "cardinality")), "rel_type").distinct()
    t = rows.where("cardinality in ('1:1', '1:N')").groupBy("rel_type", F.col("dst").alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    s = rows.where("cardinality in ('1:1', 'N:1')").groupBy("rel_type", F.col("src").alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    return t.select("rel_type", "id", F.lit("several_sources").alias("fault"), "n").unionByName(s.select("rel_type", "id", F.lit("several_targets").alias("fault"), "n"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows share, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def with_inverses(edges: DataFrame, inverse: DataFrame) -> DataFrame:
    """Edges, and for each predicate with an inverse the turned edge, without repeats."""
    turned = edges.join(inverse, "rel_type").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("inverse").alias("rel_type"))
    return edges.select("src", "dst", "rel_type").unionByName(turned).distinct()


# The base entity types with their aliases, and the base predicates: source types, target types (none: any),
# cardinality, inverse, and whether they are transitive or symmetric.
TYPES = {
    "PERSON": ("PER", "HUMAN", "INDIVIDUAL"),
    "ORGANIZATION": ("ORG", "COMPANY", "INSTITUTION", "AGENCY"),
    "LOCATION": ("LOC", "GPE", "PLACE", "GEO", "FACILITY"),
    "DATE": ("TIME", "DATETIME", "PERIOD", "TEMPORAL"),
    "EVENT": ("INCIDENT", "OCCASION", "MEETING"),
    "CONCEPT": ("IDEA", "THEORY", "METHODOLOGY", "FIELD"),
    "PRODUCT": ("SERVICE", "BRAND", "APP", "SOFTWARE"),
    "TECHNOLOGY": ("TECH", "TOOL", "FRAMEWORK", "LANGUAGE", "PROTOCOL"),
    "METRIC": ("NUMBER", "STATISTIC", "QUANTITY", "KPI", "MEASURE"),
    "DOCUMENT": ("REPORT", "ARTICLE", "PAPER", "PUBLICATION", "FILE"),
}
PREDICATES = {
    "WORKS_FOR": (("PERSON",), ("ORGANIZATION",), "N:M", "EMPLOYS", False, False),
    "EMPLOYS": (("ORGANIZATION",), ("PERSON",), "1:N", "WORKS_FOR", False, False),
    "FOUNDED": (("PERSON", "ORGANIZATION"), ("ORGANIZATION", "PRODUCT"), "N:M", None, False, False),
    "CEO_OF": (("PERSON",), ("ORGANIZATION",), "1:1", None, False, False),
    "LOCATED_IN": ((), ("LOCATION",), "N:1", None, False, False),
    "BORN_IN": (("PERSON",), ("LOCATION",), "N:1", None, False, False),
    "OWNS": ((), (), "1:N", None, False, False),
    "ACQUIRED": (("ORGANIZATION",), ("ORGANIZATION", "PRODUCT"), "N:1", None, False, False),
    "SUBSIDIARY_OF": (("ORGANIZATION",), ("ORGANIZATION",), "N:1", "PARENT_OF", True, False),
    "PART_OF": ((), (), "N:M", None, True, False),
    "CONTAINS": ((), (), "1:N", "PART_OF", True, False),
    "RELATED_TO": ((), (), "N:M", None, False, True),
    "COLLABORATES_WITH": ((), (), "N:M", None, False, True),
    "COMPETES_WITH": ((), (), "N:M", None, False, True),
    "REPORTS_TO": (("PERSON",), ("PERSON",), "N:1", "MANAGES", True, False),
    "MANAGES": (("PERSON",), ("PERSON", "ORGANIZATION"), "1:N", "REPORTS_TO", False, False),
    "PRODUCES": (("ORGANIZATION", "PERSON"), ("PRODUCT", "TECHNOLOGY"), "1:N", None, False, False),
    "USES": ((), (), "N:M", None, False, False),
    "BUILT_WITH": ((), ("TECHNOLOGY",), "N:M", None, False, False),
    "OCCURRED_ON": (("EVENT",), ("DATE",), "N:1", None, False, False),
    "FOUNDED_ON": (("ORGANIZATION",), ("DATE",), "N:1", None, False, False),
    "STUDIED_AT": (("PERSON",), ("ORGANIZATION",), "N:M", None, False, False),
    "AUTHORED": (("PERSON",), ("DOCUMENT",), "N:M", None, False, False),
}
_RULES = "predicate string, source_types array<string>, target_types array<string>, cardinality string, inverse string, transitive boolean, symmetric boolean"


def base_predicates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, list(s), list(t), *rest) for p, (s, t, *rest) in PREDICATES.items()], _RULES)


def base_types(spark: SparkSession) -> DataFrame:
    """type, parent, aliases."""
    return spark.createDataFrame([(t, None, list(a)) for t, a in TYPES.items()], "type string, parent string, aliases array<string>")


def resolved_types(rows: DataFrame, column: str, types: DataFrame) -> DataFrame:
    """rows with `resolved`: the type that a name, in any case, is or is an alias of; null where there is none."""
    known = types.select(F.col("type").alias("resolved"), F.explode(F.concat(F.array("type"), "aliases")).alias("_alias"))
    known = known.groupBy(F.upper("_alias").alias("_alias")).agg(F.min("resolved").alias("resolved"))
    return rows.withColumn("_alias", F.upper(F.trim(column))).join(known, "_alias", "left").drop("_alias")


def inferred(facts: DataFrame, predicates: DataFrame) -> DataFrame:
    """src, predicate, dst: facts and all that symmetric, inverse and transitive predicates (predicate, symmetric, inverse, transitive) add.

    A semi-naive fixpoint: each round turns the facts that the last one found, and joins them, on either side, with all
    facts of their transitive predicate; only what is new goes on, so cycles end. Chains double their length each round.
    Facts with a null are left out.
    """
    rules = predicates.select("predicate", F.coalesce("symmetric", F.lit(False)).alias("symmetric"), "inverse", F.coalesce("transitive", F.lit(False)).alias("transitive"))
    # Broadcast: a shuffle by predicate would move all facts, and those of one predicate to one task.
    rules = F.broadcast(rules)
    chained = F.broadcast(rules.where("transitive").select("predicate"))
    front = seen = cut(facts.select("src", "predicate", "dst").dropna().distinct())
    while not front.isEmpty():
        ruled = front.join(rules, "predicate")
        turn = lambda d, p: d.select(F.col("dst").alias("src"), F.col(p).alias("predicate"), F.col("src").alias("dst"))
        new = turn(ruled.where("symmetric"), "predicate").unionByName(turn(ruled.where("inverse is not null"), "inverse"))
        links = front.join(chained, "predicate", "left_semi")
        steps = seen.join(chained, "predicate", "left_semi")  # before the shuffles: other facts aren't chained
        after = steps.select(F.col("src").alias("dst"), "predicate", F.col("dst").alias("to"))
        before = steps.select(F.col("dst").alias("src"), "predicate", F.col("src").alias("from"))
        new = new.unionByName(links.join(after, ["dst", "predicate"]).select("src", "predicate", F.col("to").alias("dst")))
        new = new.unionByName(links.join(before, ["src", "predicate"]).select(F.col("from").alias("src"), "predicate", "dst"))
        front = cut(new.distinct().join(seen, ["src", "predicate", "dst"], "left_anti"))
        seen = seen.unionByName(front)  # each round's facts are written once
    return seen


def ontology_faults(types: DataFrame, predicates: DataFrame) -> DataFrame:
    """level, kind, name, message: undefined and circular parents are errors; unknown end types and inverses that aren't there or don't refer back are warnings."""
    faults = hierarchy_faults(types.select(F.col("type").alias("id"), "parent"))
    errors = faults.select(F.lit("error").alias("level"), F.lit("hierarchy").alias("kind"), F.col("id").alias("name"), F.col("fault").alias("message"))
    out = errors
    for kind, column, word in (("predicate_domain", "source_types", "Source"), ("predicate_range", "target_types", "Target")):
        ends = predicates.select("predicate", F.explode(column).alias("type")).join(types.select("type"), "type", "left_anti")
        out = out.unionByName(ends.select(F.lit("warning").alias("level"), F.lit(kind).alias("kind"), F.col("predicate").alias("name"), F.concat(F.lit(f"{word} type '"), "type", F.lit("' not in entity registry")).alias("message")))
    known = predicates.select(F.col("predicate").alias("inverse"), F.col("inverse").alias("back"), F.lit(True).alias("there"))
    turned = predicates.where("inverse is not null").select("predicate", "inverse").join(known, "inverse", "left")
    message = F.when(F.col("there").isNull(), F.concat(F.lit("Inverse predicate '"), "inverse", F.lit("' not found"))).when(~F.coalesce(F.col("back") == F.col("predicate"), F.lit(False)), F.concat(F.lit("Inverse predicate '"), "inverse", F.lit("' does not reference back")))
    turned = turned.select(F.lit("warning").alias("level"), F.when(F.col("there").isNull(), "inverse").otherwise("inverse_mismatch").alias("kind"), F.col("predicate").alias("name"), message.alias("message"))
    return out.unionByName(turned.where("message is not null"))
