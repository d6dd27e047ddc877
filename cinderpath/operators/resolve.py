"""Entity resolution: blocked candidate pairs, similarity, components; and a cascade of lookups in a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import components, cut


#: Names a key that one task compares with another's; those of a larger key are dealt out by a hash.
CROWD = 1000
#: Edits up to which names are linked by what is left of them, which needs about n ** 2 / 2 keys a name; beyond, by segments.
FEW = 2


def _edits(length, least: float):
    return F.floor((1.0 - least) * length + 1e-9).cast("int")


def _near_links(nodes: DataFrame, least: float) -> DataFrame:
    """a, b: links of names (type, norm, rep) whose components are those of all pairs of edit similarity `least` or more, the
    longer name of which may have FEW edits at most. Their number grows with the names, not with the pairs.

    A key is what is left of a name after w places are masked and c characters are cut. Two names of one key are at most
    w + c + c' edits apart, and each near pair shares a key whose w + c + c' is allowed. Edits allowed grow by one a character
    at most, so names that share a key with a near one are also near the key's first name, the one with the fewest cuts:
    each is linked with that one alone. Keys are only made where the type has names of a length that the cuts can lead to.
    """
    rows = nodes.select("type", "norm", "rep", F.length("norm").alias("n"), _edits(F.length("norm"), least).alias("d")).where("n > 0")
    lengths = rows.groupBy("type").agg(F.collect_set("n").alias("lengths"))
    has = lambda by: F.array_contains("lengths", F.col("n") + by)
    allowed = lambda by: _edits(F.col("n") + by, least)
    key = lambda w, c, when: F.when(when, F.struct(F.lit(w).alias("w"), F.lit(c).alias("c")))
    kinds = F.array(
        key(2, 0, F.col("d") == 2),
        key(1, 0, (F.col("d") == 1) | (has(1) & (allowed(1) == 2))),
        key(0, 0, (has(1) & (allowed(1) == 1)) | (has(2) & (allowed(2) == 2))),
        key(0, 1, (F.col("d") == 2) | ((F.col("d") == 1) & has(-1))),
        key(1, 1, (F.col("d") == 2) & has(-1)),
        key(0, 2, (F.col("d") == 2) & has(-2)),
    )
    places = F.expr(
        "CASE w + c WHEN 0 THEN array(struct(-1 AS i, -1 AS j)) WHEN 1 THEN transform(sequence(0, n - 1), i -> struct(i, -1 AS j)) "
        "ELSE flatten(transform(sequence(0, greatest(n - 2, 0)), i -> transform(filter(sequence(i, n - 1), j -> j > i), j -> struct(i, j)))) END"
    )
    left = F.expr("CASE w + c WHEN 0 THEN norm WHEN 1 THEN concat(substr(norm, 1, i), substr(norm, i + 2)) ELSE concat(substr(norm, 1, i), substr(norm, i + 2, j - i - 1), substr(norm, j + 2)) END")
    # Masked places are counted after the cuts; of a masked and a cut one either may be the first.
    masks = F.expr("CASE WHEN w = 0 THEN array(-1) WHEN w = 1 AND c = 0 THEN array(i) WHEN w = 1 THEN array(i, j - 1) ELSE array(i * 1000 + j) END")
    rows = rows.where(F.col("d") <= FEW).join(F.broadcast(lengths), "type").select("type", "norm", "rep", "n", "d", F.explode(F.array_compact(kinds)).alias("kind"))
    rows = rows.select("type", "norm", "rep", "n", "d", "kind.w", "kind.c").select("*", F.explode(places).alias("at")).select("*", "at.i", "at.j")
    rows = rows.select("type", "w", "c", "d", "rep", left.alias("left"), F.explode(masks).alias("mask"))
    first = F.min(F.struct("c", "rep")).over(Window.partitionBy("type", "w", "mask", "left"))
    linked = rows.withColumn("first", first).where("rep <> first.rep and w + c + first.c <= d")
    return linked.select(F.col("rep").alias("a"), F.col("first.rep").alias("b")).distinct()


def _pairs(nodes: DataFrame, least: float, over: int = -1) -> DataFrame:
    """type, x, y: different names of a type, among them every pair whose edit similarity is `least` or more and whose longer
    name may have more than `over` edits.

    Such names are at most d = (1 - least) * l edits apart, l being the longer one's length. Cut in d + 1 segments, the
    longer one has a segment that the other has too, at most d places away (pigeonhole): that is the joins' key.
    """
    edits = lambda l: _edits(l, least)
    begin = lambda l, j: F.floor(j * l / (edits(l) + 1)).cast("int")
    part = lambda s, at, n: s.substr(at + 1, n)
    rows = nodes.select("type", "norm", F.length("norm").alias("n")).where("n > 0")
    own = rows.where(edits(F.col("n")) > over).select("type", F.col("norm").alias("x"), F.col("n").alias("l"), F.explode(F.sequence(F.lit(0), edits(F.col("n")))).alias("j"))
    own = own.select("type", "x", "l", "j", part(F.col("x"), begin(F.col("l"), F.col("j")), begin(F.col("l"), F.col("j") + 1) - begin(F.col("l"), F.col("j"))).alias("key"))
    longest = F.ceil(F.col("n") / F.lit(least)).cast("int")
    other = rows.select("type", F.col("norm").alias("y"), "n", F.explode(F.sequence(F.col("n"), longest)).alias("l")).where((F.col("l") - F.col("n") <= edits(F.col("l"))) & (edits(F.col("l")) > over))
    other = other.select("*", F.explode(F.sequence(F.lit(0), edits(F.col("l")))).alias("j"))
    other = other.select("*", begin(F.col("l"), F.col("j")).alias("at"), begin(F.col("l"), F.col("j") + 1).alias("end"))
    other = other.select("*", F.explode(F.sequence(-edits(F.col("l")), edits(F.col("l")))).alias("by"))
    other = other.where("at + by >= 0 and end + by <= n").select("type", "y", "l", "j", part(F.col("y"), F.col("at") + F.col("by"), F.col("end") - F.col("at")).alias("key")).distinct()
    keys = ["type", "l", "j", "key"]
    own = cut(own)
    crowded = F.broadcast(own.groupBy(keys).agg(F.ceil(F.count("*") / CROWD).cast("int").alias("salts")).where("salts > 1"))
    salts = F.coalesce("salts", F.lit(1))
    own = own.join(crowded, keys, "left").select(*keys, "x", F.pmod(F.xxhash64("x"), salts).cast("int").alias("salt"))
    other = other.join(crowded, keys, "left").select(*keys, "y", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    found = own.join(other, [*keys, "salt"]).where("length(y) < l or x < y")
    # Names come normalised; the distance is given up once it is over what is allowed.
    found = found.withColumn("most", F.greatest(F.length("x"), F.length("y"))).where(F.expr(f"x = y or levenshtein(x, y, cast(floor({1.0 - least!r} * most + 1e-9) as int)) >= 0"))
    return found.select("type", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def resolve(entities: DataFrame, least: float = 0.85) -> DataFrame:
    """id, cluster (the least id of a cluster) of entities (id, type, name).

    Equal normalised names of a type are one node, so copies never pair up. Links join what all pairs of different names with
    edit similarity of `least` or more join.
    Rows with a null id or name are clusters of their own, if they have an id.
    """
    rows = entities.where("id is not null").select("id", "type", T.normalize_name("name").alias("norm"))
    nodes = cut(rows.where("norm is not null").groupBy("type", "norm").agg(F.min("id").alias("rep")))
    links = _pairs(nodes, least, FEW)
    ids = nodes.select("type", "norm", "rep")
    edges = links.join(ids.select("type", F.col("norm").alias("x"), F.col("rep").alias("a")), ["type", "x"]).join(ids.select("type", F.col("norm").alias("y"), F.col("rep").alias("b")), ["type", "y"]).select("a", "b").unionByName(_near_links(nodes, least))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    comps = components(both, nodes.select(F.col("rep").alias("id")))
    member = rows.join(nodes, ["type", "norm"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return member.join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("cluster"))


def merged(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, n, name (of the least id), description (the longest), confidence (mean times 1.1, at most 1)."""
    rows = entities.join(clusters, "id")
    return rows.groupBy("cluster").agg(
        F.count("*").alias("n"),
        F.min_by("name", "id").alias("name"),
        F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), F.col("description"))).alias("description"),
        F.round(F.least(F.avg("confidence") * 1.1, F.lit(1.0)), 6).alias("confidence"),
    )


def lookup(mentions: DataFrame, registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """mention, id, stage: the canonical entity of each mention by its name, else by an alias, else a new id.

    Each stage is an equi-join on normalised names; ties go to the least id.
    """
    names = registry.groupBy(T.normalize_name("name").alias("norm")).agg(F.min("id").alias("by_name"))
    known = aliases.groupBy(T.normalize_name("alias").alias("norm")).agg(F.min("id").alias("by_alias"))
    rows = mentions.select("mention", T.normalize_name("mention").alias("norm")).join(names, "norm", "left").join(known, "norm", "left")
    stage = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_alias").isNotNull(), "alias").otherwise("created")
    return rows.select("mention", F.coalesce("by_name", "by_alias", T.hash_id([F.lit("canonical"), F.col("norm")])).alias("id"), stage.alias("stage"))


def merge_aliases(aliases: DataFrame, source: str, target: str) -> DataFrame:
    """Aliases after an entity was merged into another."""
    return aliases.select(F.when(F.col("id") == source, target).otherwise(F.col("id")).alias("id"), "alias").distinct()


def add_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases (id, alias) with new ones, each once whatever its case."""
    return aliases.unionByName(new).groupBy("id", F.lower(F.trim("alias")).alias("_key")).agg(F.min("alias").alias("alias")).select("id", "alias")


def remove_aliases(aliases: DataFrame, gone: DataFrame) -> DataFrame:
    key = lambda d: d.select("id", F.lower(F.trim("alias")).alias("_key"))
    return aliases.withColumn("_key", F.lower(F.trim("alias"))).join(key(gone), ["id", "_key"], "left_anti").select("id", "alias")


def merge_entities(registry: DataFrame, aliases: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, aliases) after merges (source, target): sources go, and their names and aliases become the target's.

    A target that is a source itself is not followed: merge step by step.
    """
    moved = merges.select(F.col("source").alias("id"), "target")
    names = registry.join(moved, "id").select(F.col("target").alias("id"), F.col("name").alias("alias"))
    pointed = aliases.join(moved, "id", "left").select(F.coalesce("target", "id").alias("id"), "alias")
    return registry.join(moved.select("id"), "id", "left_anti"), add_aliases(pointed, names)


def registry_search(registry: DataFrame, aliases: DataFrame, word: str) -> DataFrame:
    """id, name, n_aliases of entities whose name or alias has a word in it, whatever its case."""
    hit = lambda c: F.contains(F.lower(c), F.lit(word.lower()))
    ids = registry.where(hit("name")).select("id").unionByName(aliases.where(hit("alias")).select("id")).distinct()
    counts = aliases.groupBy("id").agg(F.count("*").alias("n_aliases"))
    return registry.join(ids, "id", "left_semi").join(counts, "id", "left").select("id", "name", F.coalesce("n_aliases", F.lit(0)).cast("long").alias("n_aliases"))


def matches(candidates: DataFrame, query: str, least: float = 0.7) -> DataFrame:
    """id, score of the entities (id, name, description) that a query may mean: 0.95 if one name holds the other, 0.8 if half of
    the query's words are in the name, the edit similarity from `least` on, 0.7 if the description has the query."""
    q, name = query.strip().lower(), F.lower(F.trim("name"))
    words = [w for w in q.split() if w]
    shared = sum((F.contains(name, F.lit(w)).cast("int") for w in words), F.lit(0))
    edit = T.edit_similarity("name", F.lit(query))
    score = (
        F.when(F.contains(name, F.lit(q)) | F.contains(F.lit(q), name), 0.95)
        .when(shared * 2 >= len(words), 0.8)
        .when(edit >= least, edit)
        .when(F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(q)), 0.7)
    )
    return candidates.where(name != "").select("id", score.alias("score")).where("score is not null")
