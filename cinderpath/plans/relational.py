"""Queries over the graph tables: filters, pattern joins, anti joins, set operations, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching as M
from ..session import table
from .model import CHUNKS, GRAPH, chunks, edges, entities, undirected
from .registry import query


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return entities(spark, sf_dir), edges(spark, sf_dir)


@query(
    GRAPH + "SELECT n.id, n.name, n.type, count(*) AS degree, count(DISTINCT b.b) AS n_neighbors, round(avg(b.confidence), 6) AS avg_confidence "
    "FROM entities n JOIN both_ways b ON b.a = n.id WHERE NOT coalesce(n.is_deleted, false) GROUP BY n.id, n.name, n.type ORDER BY degree DESC, id LIMIT 50"
)
def graph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the best connected active entities, with their neighbourhood's size and confidence."""
    nodes, edge = _graph(spark, sf_dir)
    around = undirected(edge).groupBy("a").agg(F.count("*").alias("degree"), F.countDistinct("b").alias("n_neighbors"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    out = M.active(nodes).join(around, F.col("id") == F.col("a"))
    return out.select("id", "name", "type", "degree", "n_neighbors", "avg_confidence").orderBy(F.desc("degree"), "id").limit(50)


@query(GRAPH + "SELECT id, name FROM entities WHERE type = 'LOCATION'")
def filter_by_type(spark, sf_dir):
    return entities(spark, sf_dir).where("type = 'LOCATION'").select("id", "name")


@query(GRAPH + "SELECT id, name FROM entities WHERE contains(lower(name), lower('WIDget'))")
def filter_name_contains(spark, sf_dir):
    return entities(spark, sf_dir).where(M.contains_ci("name", "WIDget")).select("id", "name")


@query(GRAPH + "SELECT id, name, description FROM entities WHERE contains(lower(coalesce(name, '')), 'nation') OR contains(lower(coalesce(description, '')), 'nation')")
def filter_any_field(spark, sf_dir):
    return entities(spark, sf_dir).where(M.any_field_contains(["name", "description"], "Nation")).select("id", "name", "description")


@query(GRAPH + "SELECT src, dst, rel_type FROM edges WHERE rel_type IN ('PART_OF', 'LOCATED_IN')")
def filter_in_list(spark, sf_dir):
    return edges(spark, sf_dir).where(F.col("rel_type").isin("PART_OF", "LOCATED_IN")).select("src", "dst", "rel_type")


@query(CHUNKS + "SELECT doc_id, pos, length(text) AS n FROM chunks WHERE contains(text, 'license') OR contains(text, 'License') OR contains(text, 'http')")
def filter_chunks_mentioning(spark, sf_dir):
    hit = chunks(table(spark, sf_dir, "documents")).where(M.any_contains("text", ["license", "License", "http"]))
    return hit.select("doc_id", "pos", F.length("text").cast("long").alias("n"))


@query(GRAPH + "SELECT id, confidence FROM entities WHERE confidence >= 0.9 ORDER BY confidence DESC, id LIMIT 20")
def topk_confident(spark, sf_dir):
    return entities(spark, sf_dir).where("confidence >= 0.9").select("id", "confidence").orderBy(F.desc("confidence"), "id").limit(20)


@query(GRAPH + "SELECT id, name FROM entities WHERE type = 'ORGANIZATION' ORDER BY name, id LIMIT 25 OFFSET 50")
def page_of_entities(spark, sf_dir):
    return entities(spark, sf_dir).where("type = 'ORGANIZATION'").select("id", "name").orderBy("name", "id").offset(50).limit(25)


@query(GRAPH + "SELECT e.src, a.name AS src_name, e.dst, b.name AS dst_name, e.confidence FROM edges e JOIN entities a ON a.id = e.src JOIN entities b ON b.id = e.dst WHERE e.confidence >= 0.8")
def confident_edges(spark, sf_dir):
    nodes, edge = _graph(spark, sf_dir)
    return M.one_hop(nodes, edge.where("confidence >= 0.8")).select("src", "src_name", "dst", "dst_name", "confidence")


@query(GRAPH + "SELECT id, description FROM entities WHERE description IS NOT NULL AND length(description) > 0")
def filter_described(spark, sf_dir):
    return entities(spark, sf_dir).where("description is not null and length(description) > 0").select("id", "description")


@query(GRAPH + "SELECT id, type, version FROM entities WHERE NOT coalesce(is_deleted, false)")
def filter_active(spark, sf_dir):
    return M.active(entities(spark, sf_dir)).select("id", "type", "version")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ordered_on FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def filter_time_range(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1998-06-01' and o_orderdate < timestamp_ntz'1999-01-01'")
    return rows.select("o_orderkey", F.to_date("o_orderdate").alias("ordered_on"))


@query(GRAPH + "SELECT id, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, concat(type, ':', name) AS label FROM entities")
def project_bands(spark, sf_dir):
    band = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low")
    return entities(spark, sf_dir).select("id", band.alias("band"), F.concat("type", F.lit(":"), "name").alias("label"))


@query(CHUNKS + "SELECT doc_id, pos, start_char, substr(text, 1, 80) AS preview FROM chunks")
def chunk_previews(spark, sf_dir):
    return chunks(table(spark, sf_dir, "documents")).select("doc_id", "pos", "start_char", F.substring("text", 1, 80).alias("preview"))


@query(
    GRAPH + "SELECT id, concat_ws(',', CASE WHEN name IS NULL OR name = '' THEN 'name' END, CASE WHEN description IS NULL OR description = '' THEN 'description' END) AS missing "
    "FROM entities WHERE name IS NULL OR name = '' OR description IS NULL OR description = ''"
)
def missing_required(spark, sf_dir):
    return M.missing_fields(entities(spark, sf_dir), ["name", "description"]).select("id", "missing")


@query(GRAPH + ", k AS (SELECT id FROM entities WHERE confidence >= 0.3) SELECT src, dst, rel_type FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def pruned_edges(spark, sf_dir):
    nodes, edge = _graph(spark, sf_dir)
    return M.between(edge, nodes.where("confidence >= 0.3")).select("src", "dst", "rel_type")


@query(GRAPH + "SELECT e.src, a.name AS src_name, e.rel_type, e.dst, b.name AS dst_name FROM edges e JOIN entities a ON a.id = e.src JOIN entities b ON b.id = e.dst WHERE e.rel_type <> 'PRODUCES'")
def one_hop_directed(spark, sf_dir):
    nodes, edge = _graph(spark, sf_dir)
    return M.one_hop(nodes, edge.where("rel_type <> 'PRODUCES'")).select("src", "src_name", "rel_type", "dst", "dst_name")


@query(GRAPH + "SELECT a AS id, b AS neighbor, rel_type FROM both_ways JOIN entities n ON n.id = a WHERE n.type = 'LOCATION'")
def one_hop_undirected(spark, sf_dir):
    nodes, edge = _graph(spark, sf_dir)
    places = nodes.where("type = 'LOCATION'").select(F.col("id").alias("a"))
    return undirected(edge).join(places, "a", "left_semi").select(F.col("a").alias("id"), F.col("b").alias("neighbor"), "rel_type")


@query(GRAPH + "SELECT a.type AS src_type, e.rel_type, b.type AS dst_type, count(*) AS n FROM edges e JOIN entities a ON a.id = e.src JOIN entities b ON b.id = e.dst GROUP BY ALL")
def typed_edge_counts(spark, sf_dir):
    nodes, edge = _graph(spark, sf_dir)
    return M.one_hop(nodes, edge).groupBy("src_type", "rel_type", "dst_type").agg(F.count("*").alias("n"))


@query(
    GRAPH + "SELECT DISTINCT x.a AS start, y.b AS hop2 FROM both_ways x JOIN both_ways y ON x.b = y.a JOIN entities n ON n.id = x.a "
    "WHERE n.type = 'LOCATION' AND y.b <> x.a"
)
def two_hops(spark, sf_dir):
    nodes, edge = _graph(spark, sf_dir)
    return M.two_hops(undirected(edge), nodes.where("type = 'LOCATION'"))


@query(GRAPH + "SELECT id, type FROM entities WHERE NOT coalesce(is_deleted, false) AND id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def orphan_entities(spark, sf_dir):
    return M.orphans(*_graph(spark, sf_dir)).select("id", "type")


@query(CHUNKS + "SELECT doc_id, pos FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_chunks(spark, sf_dir):
    return chunks(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "pos")


@query(
    GRAPH + "SELECT src, dst, rel_type, coalesce(a.is_deleted, false) AS src_deleted, coalesce(b.is_deleted, false) AS dst_deleted FROM edges "
    "JOIN entities a ON a.id = src JOIN entities b ON b.id = dst WHERE coalesce(a.is_deleted, false) OR coalesce(b.is_deleted, false)"
)
def dangling_edges(spark, sf_dir):
    return M.dangling(*_graph(spark, sf_dir))


@query(GRAPH + "SELECT id, count(*) AS n_edges FROM entities JOIN both_ways ON a = id WHERE is_deleted GROUP BY id")
def inconsistent_entities(spark, sf_dir):
    nodes, edge = _graph(spark, sf_dir)
    return M.inconsistent(nodes, undirected(edge))


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey = l_suppkey")
def self_references(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_partkey = l_suppkey").select("l_orderkey", "l_partkey", "l_suppkey")


@query(
    GRAPH + "SELECT dst AS community, count(*) AS n_members, string_agg(src, ',' ORDER BY src) AS members FROM edges WHERE rel_type = 'LOCATED_IN' AND src LIKE 'S:%' GROUP BY dst"
)
def community_members(spark, sf_dir):
    """Members of each place; suppliers of a nation number some thousandths of the table."""
    rows = edges(spark, sf_dir).where("rel_type = 'LOCATED_IN' and src like 'S:%'")
    return rows.groupBy(F.col("dst").alias("community")).agg(F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_list("src")), ",").alias("members"))


@query(GRAPH + "SELECT dst AS community, src AS member FROM edges WHERE rel_type = 'LOCATED_IN'")
def all_community_members(spark, sf_dir):
    """A row for each member of each place, of every kind; community_members lists suppliers alone."""
    return edges(spark, sf_dir).where("rel_type = 'LOCATED_IN'").select(F.col("dst").alias("community"), F.col("src").alias("member"))


@query(
    "SELECT l.l_orderkey AS order_id, l.l_suppkey AS supplier, s.s_nationkey AS nation, count(*) AS n FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey "
    "JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderpriority = '1-URGENT' GROUP BY ALL"
)
def linked_lookup(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(urgent, "l_orderkey", "left_semi")
    counted = lines.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    out = counted.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return out.select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"), "n")


@query(GRAPH + "SELECT n.id, n.name, e.dst AS place FROM entities n LEFT JOIN edges e ON e.src = n.id AND e.rel_type = 'LOCATED_IN' WHERE n.type IN ('ORGANIZATION', 'LOCATION')")
def optional_place(spark, sf_dir):
    nodes, edge = _graph(spark, sf_dir)
    place = edge.where("rel_type = 'LOCATED_IN'").select(F.col("src").alias("id"), F.col("dst").alias("place"))
    return nodes.where("type in ('ORGANIZATION', 'LOCATION')").join(place, "id", "left").select("id", "name", "place")


def _stored(nodes: DataFrame) -> DataFrame:
    """An earlier state of the nodes: some are missing, some had another name, some another confidence."""
    number = F.substring("id", 3, 20).cast("long")
    return nodes.where(number % 11 != 0).select(
        "id",
        F.when(number % 7 == 0, F.concat("name", F.lit(" (old)"))).otherwise(F.col("name")).alias("name"),
        "type",
        F.when(number % 5 == 0, F.lit(0.01)).otherwise(F.col("confidence")).alias("confidence"),
    )


@query(
    GRAPH + ", n AS (SELECT id, name, type, confidence, CAST(substr(id, 3) AS BIGINT) AS k FROM entities), "
    "o AS (SELECT id, CASE WHEN k % 7 = 0 THEN concat(name, ' (old)') ELSE name END AS name, type, CASE WHEN k % 5 = 0 THEN 0.01 ELSE confidence END AS confidence FROM n WHERE k % 11 <> 0) "
    "SELECT n.id, CASE WHEN o.id IS NULL THEN 'NEW' WHEN o.name <> n.name OR o.type <> n.type THEN 'MODIFIED' WHEN o.confidence <> n.confidence THEN 'EXTRA_ONLY' ELSE 'UNCHANGED' END AS change "
    "FROM n LEFT JOIN o ON o.id = n.id"
)
def changed_entities(spark, sf_dir):
    nodes = entities(spark, sf_dir).select("id", "name", "type", "confidence")
    return M.changes(_stored(nodes), nodes, ["id"], ["name", "type"], ["confidence"])


@query(
    "WITH now AS (SELECT l_orderkey AS o, l_linenumber AS n, first(l_quantity ORDER BY l_partkey) AS q, first(l_tax ORDER BY l_partkey) AS t FROM lineitem GROUP BY ALL), "
    "old AS (SELECT o, n, CASE WHEN o % 7 = 0 THEN q + 1 ELSE q END AS q, CASE WHEN o % 5 = 0 THEN -1.0 ELSE t END AS t FROM now WHERE o % 11 <> 0) "
    "SELECT now.o AS order_id, now.n AS line, CASE WHEN old.o IS NULL THEN 'NEW' WHEN old.q <> now.q THEN 'MODIFIED' WHEN old.t <> now.t THEN 'EXTRA_ONLY' ELSE 'UNCHANGED' END AS change "
    "FROM now LEFT JOIN old ON old.o = now.o AND old.n = now.n"
)
def changed_relations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"))
    # now is computed twice, so lines of one part in a line of an order need an order of their own; unknown parts come last, as in the SQL.
    first = F.min(F.struct(F.isnull("l_partkey").alias("unknown"), "l_partkey", F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"))).alias("v")
    now = lines.agg(first).select("order_id", "line", "v.q", "v.t")
    old = now.where("order_id % 11 <> 0").select(
        "order_id", "line", F.when(F.col("order_id") % 7 == 0, F.col("q") + 1).otherwise(F.col("q")).alias("q"), F.when(F.col("order_id") % 5 == 0, F.lit(-1.0)).otherwise(F.col("t")).alias("t")
    )
    return M.changes(old, now, ["order_id", "line"], ["q"], ["t"])


@query(
    GRAPH + "SELECT 'node' AS kind, type AS label, count(*) AS n FROM entities GROUP BY type UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY rel_type"
)
def label_counts(spark, sf_dir):
    nodes, edge = _graph(spark, sf_dir)
    tagged = nodes.select(F.lit("node").alias("kind"), F.col("type").alias("label")).unionByName(edge.select(F.lit("edge").alias("kind"), F.col("rel_type").alias("label")))
    return tagged.groupBy("kind", "label").agg(F.count("*").alias("n"))


@query(
    GRAPH + ", l AS (SELECT id, name, 'left' AS side FROM entities WHERE type <> 'PRODUCT'), r AS (SELECT id, upper(name) AS name, 'right' AS side FROM entities WHERE type <> 'LOCATION') "
    "SELECT * FROM l UNION ALL SELECT * FROM r WHERE id NOT IN (SELECT id FROM l)"
)
def merged_nodes(spark, sf_dir):
    nodes, edge = _graph(spark, sf_dir)
    left = nodes.where("type <> 'PRODUCT'").select("id", "name", F.lit("left").alias("side"))
    right = nodes.where("type <> 'LOCATION'").select("id", F.upper("name").alias("name"), F.lit("right").alias("side"))
    return M.merge_graphs((left, edge), (right, edge))[0]


@query(GRAPH + "SELECT name FROM entities WHERE type = 'PRODUCT' INTERSECT SELECT p_name FROM part WHERE p_size > 25")
def shared_names(spark, sf_dir):
    nodes = entities(spark, sf_dir).where("type = 'PRODUCT'").select("name")
    return nodes.intersect(table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_name").alias("name")))


@query("SELECT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 5000")
def ids_difference(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal < 5000").select(F.col("c_custkey").alias("key"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct().join(rich, "key", "left_anti")


@query("SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier UNION SELECT p_name FROM part")
def distinct_names(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    return names.union(table(spark, sf_dir, "supplier").select("s_name")).union(table(spark, sf_dir, "part").select("p_name")).distinct()


@query(GRAPH + "SELECT name FROM entities UNION SELECT n_name FROM nation")
def all_distinct_names(spark, sf_dir):
    """Names of all entities, places too; distinct_names has customers, suppliers and parts."""
    return entities(spark, sf_dir).select("name").union(table(spark, sf_dir, "nation").select("n_name")).distinct()


@query(
    "WITH s AS (SELECT o_custkey AS c, list_distinct(list(o_orderpriority)) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), "
    "t AS (SELECT o_custkey AS c, list_distinct(list(o_orderpriority)) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) "
    "SELECT c AS customer, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS jaccard FROM s JOIN t USING (c)"
)
def set_jaccard(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    sets = orders.groupBy(F.col("o_custkey").alias("customer")).agg(
        F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("a"), F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("b")
    )
    return sets.where("size(a) > 0 and size(b) > 0").select("customer", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


@query(
    "SELECT o_custkey AS customer, o_orderkey AS order_id, o_totalprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1"
)
def first_of_key(spark, sf_dir):
    """First-wins dedup by an order, as one aggregation."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("price"), (-F.col("o_totalprice")).alias("rank"))
    return M.first_by(rows, ["customer"], ["rank", "order_id"]).select("customer", "order_id", "price")


@query(
    "SELECT l.l_suppkey AS subject, concat('P:', l.l_partkey) AS object, s.s_name AS subject_name, p.p_name AS object_name, count(*) AS support FROM lineitem l "
    "JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY ALL HAVING count(*) >= 3"
)
def triplets(spark, sf_dir):
    """Relations with both ends' names; relations are counted before they meet the names."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("support")).where("support >= 3")
    named = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return named.select(F.col("l_suppkey").alias("subject"), F.concat(F.lit("P:"), "l_partkey").alias("object"), F.col("s_name").alias("subject_name"), F.col("p_name").alias("object_name"), "support")
