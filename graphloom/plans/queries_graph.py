"""Queries over entities, relations and the property graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.ids import fused_id
from ..operators import cluster, graph, merge
from .fixtures import ENTITIES, GRAPH, RELATIONS, edges, entities, line_id, nodes, relations, table
from .registry import query


def _keys(rows, keys):
    """keys, key, value of every property."""
    return rows.select(*keys, F.explode("props").alias("key", "value"))


@query(f"WITH {ENTITIES} SELECT type, name, key, arg_min(value, ord) AS value FROM props GROUP BY type, name, key")
def entity_first_wins(spark, sf):
    return _keys(merge.merge_entities(entities(spark, sf)), ["type", "name"])


@query(f"WITH {ENTITIES} SELECT type || '_' || name AS node_id, key, arg_max(value, ord) AS value FROM props GROUP BY ALL")
def node_last_wins(spark, sf):
    return _keys(merge.build_nodes(entities(spark, sf).withColumn("description", F.lit(None).cast("string"))), ["node_id"])


@query(f"WITH {ENTITIES} SELECT type, name, key, arg_max(value, ord) AS value FROM props GROUP BY type, name, key")
def node_last_wins_exploded(spark, sf):
    return merge.exploded_winner(entities(spark, sf), ["type", "name"], "props", "ord")


@query("SELECT 'part_' || p_name AS node_id, arg_max(p_type, p_partkey) AS description, string_agg(DISTINCT 'f' || p_partkey % 4, ',' ORDER BY 'f' || p_partkey % 4) AS files, arg_max(p_brand, p_partkey) AS brand FROM part GROUP BY 1")
def crossdoc_node_merge(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(F.concat(F.lit("part_"), "p_name").alias("node_id"), F.col("p_name").alias("node_name"), F.lit("part").alias("node_type"), F.col("p_type").alias("description"), F.create_map(F.lit("brand"), "p_brand").alias("props"), F.array(F.concat(F.lit("f"), (F.col("p_partkey") % 4).cast("string"))).alias("filename"), F.col("p_partkey").alias("ord"))
    return merge.merge_nodes_across(rows).select("node_id", "description", F.array_join("filename", ",").alias("files"), F.col("props")["brand"].alias("brand"))


@query("SELECT l_partkey AS source_id, l_suppkey AS target_id, 'supplied by' AS relation_type, arg_max(l_quantity, (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey, l_quantity, l_returnflag)) AS weight, arg_max(l_returnflag, (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey, l_quantity, l_returnflag)) AS flag FROM lineitem GROUP BY ALL")
def crossdoc_edge_merge(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.lit("supplied by").alias("relation_type"), F.col("l_quantity").alias("weight"), F.lit(False).alias("bidirectional"), F.create_map(F.lit("flag"), "l_returnflag").alias("props"), F.struct(line_id().alias("line"), "l_quantity", "l_returnflag").alias("ord"))
    return merge.merge_edges_across(rows).select("source_id", "target_id", "relation_type", "weight", F.col("props")["flag"].alias("flag"))


@query(f"WITH {RELATIONS} SELECT source, type, target, min(ord) AS ord FROM relations GROUP BY ALL")
def relation_distinct(spark, sf):
    return merge.distinct_relations(relations(spark, sf))


def _built(spark, sf):
    return merge.build_nodes(entities(spark, sf).withColumn("description", F.lit(None).cast("string")))


@query(f"""WITH {ENTITIES}, {RELATIONS}, n AS (SELECT type, name, min(ord) AS ord FROM entities GROUP BY ALL), first AS (SELECT name, arg_min(type || '_' || name, ord) AS id FROM n GROUP BY name)
SELECT s.id AS source_id, r.type AS relation_type, t.id AS target_id, min(r.ord) AS ord FROM relations r JOIN first s ON s.name = r.source JOIN first t ON t.name = r.target GROUP BY ALL""")
def edge_dedupe_first(spark, sf):
    return merge.build_edges(relations(spark, sf), _built(spark, sf)).select("source_id", "relation_type", "target_id", "ord")


@query(f"WITH {ENTITIES}, {RELATIONS} SELECT count(*) AS n, count(DISTINCT source) AS sources FROM relations WHERE source IN (SELECT name FROM entities) AND target IN (SELECT name FROM entities)")
def endpoint_resolution(spark, sf):
    return merge.resolve_endpoints(relations(spark, sf), _built(spark, sf)).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query(f"WITH {ENTITIES}, {RELATIONS} SELECT source, type, target, ord FROM relations WHERE source NOT IN (SELECT name FROM entities) OR target NOT IN (SELECT name FROM entities)")
def unresolved_edges(spark, sf):
    return merge.unresolved(relations(spark, sf), _built(spark, sf)).select("source", "type", "target", "ord")


def _incoming(spark, sf):
    """Suppliers again, with another property, and as many new nodes."""
    s = table(spark, sf, "supplier")
    arr = lambda x: F.array(F.lit(x))
    shape = lambda name, **p: s.select(F.lit("kg").alias("graph_tag"), F.concat(F.lit("supplier_"), name).alias("node_id"), name.alias("node_name"), F.lit("supplier").alias("node_type"), F.lit("again").alias("description"), F.create_map(F.lit("nation"), F.lit("?"), F.lit("balance"), F.round("s_acctbal", 2).cast("decimal(12,2)").cast("string")).alias("props"), arr("new.md").alias("filename"), arr("GlobalLevel").alias("graph_level"), F.col("s_suppkey").alias("ord"))
    return shape(F.col("s_name")).unionByName(shape(F.concat(F.lit("new "), "s_name")))


@query(f"WITH {ENTITIES}, old AS (SELECT DISTINCT type || '_' || name AS node_id FROM entities) SELECT node_id, CAST(NULL AS VARCHAR) AS description, 'kg.md' AS files FROM old UNION ALL SELECT 'supplier_new ' || s_name, 'again', 'new.md' FROM supplier")
def upsert_create_only(spark, sf):
    out = graph.upsert_nodes(nodes(spark, sf, False), _incoming(spark, sf))
    return out.select("node_id", "description", F.array_join("filename", ",").alias("files"))


@query(f"""WITH {ENTITIES}, old AS (SELECT DISTINCT type || '_' || name AS node_id, type FROM entities)
SELECT node_id, CASE WHEN type = 'supplier' THEN 'again' END AS description, CASE WHEN type = 'supplier' THEN 'kg.md,new.md' ELSE 'kg.md' END AS files, CASE WHEN type = 'supplier' THEN '?' END AS nation FROM old
UNION ALL SELECT 'supplier_new ' || s_name, 'again', 'new.md', '?' FROM supplier""")
def upsert_overwrite(spark, sf):
    out = graph.upsert_nodes(nodes(spark, sf, False), _incoming(spark, sf), "overwrite")
    return out.select("node_id", "description", F.array_join("filename", ",").alias("files"), F.when(F.col("node_type") == "supplier", F.col("props")["nation"]).alias("nation"))


def _new_edges(spark, sf):
    n = table(spark, sf, "nation")
    arr = F.array().cast("array<string>")
    return n.select(F.lit("kg").alias("graph_tag"), F.concat(F.lit("nation_"), "n_name").alias("source_id"), F.lit("trades with").alias("relation_type"), F.when(F.col("n_nationkey") % 5 == 0, "nation_nowhere").otherwise(F.concat(F.lit("nation_"), F.first("n_name").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))).alias("target_id"), F.lit(2.0).alias("weight"), F.lit(True).alias("bidirectional"), F.create_map(F.lit("new"), F.lit("1")).alias("props"), arr.alias("filename"), arr.alias("graph_level"), F.col("n_nationkey").alias("ord"))


@query(f"""WITH {GRAPH}, f AS (SELECT n_nationkey, n_name, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS t FROM nation)
SELECT source_id, relation_type, target_id, 1.0::DOUBLE AS weight FROM edges WHERE graph_tag = 'kg'
UNION ALL SELECT 'nation_' || n_name, 'trades_with', 'nation_' || t, 2.0 FROM f WHERE n_nationkey % 5 <> 0""")
def upsert_edge(spark, sf):
    n = nodes(spark, sf, False)
    return graph.upsert_edges(edges(spark, sf, False), _new_edges(spark, sf), n).select("source_id", "relation_type", "target_id", "weight")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'a,b' WHEN s_suppkey % 3 = 1 THEN 'a,b' ELSE 'b' END AS files FROM supplier")
def append_if_absent(spark, sf):
    k = F.col("s_suppkey") % 3
    have = F.when(k == 0, F.array(F.lit("a"), F.lit("b"))).when(k == 1, F.array(F.lit("a")))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(graph.append_if_absent(have, F.lit("b")), ",").alias("files"))


@query(f"WITH {GRAPH} SELECT 'nodes' AS kind, count(*) AS n FROM nodes WHERE graph_tag <> 'task_building' UNION ALL SELECT 'edges', count(*) FROM edges WHERE graph_tag <> 'task_building'")
def delete_subgraph(spark, sf):
    n, e = graph.delete_graph(nodes(spark, sf), edges(spark, sf), "task_building")
    return n.agg(F.lit("nodes").alias("kind"), F.count("*").alias("n")).union(e.agg(F.lit("edges").alias("kind"), F.count("*").alias("n")))


@query(f"""WITH {ENTITIES}, seg AS (SELECT 'customer_' || c_name AS node_id, CAST(c_nationkey AS VARCHAR) AS nation FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 3 <> 0),
old AS (SELECT DISTINCT type || '_' || name AS node_id, type FROM entities)
SELECT o.node_id, CASE WHEN o.type = 'customer' THEN coalesce(CASE WHEN s.node_id IS NOT NULL THEN '?' END, c_mktsegment) END AS segment, s.nation
FROM old o LEFT JOIN seg s USING (node_id) LEFT JOIN customer c ON o.node_id = 'customer_' || c.c_name""")
def merge_graphs(spark, sf):
    n, _ = graph.merge_graph(nodes(spark, sf), edges(spark, sf), "task_building", "kg")
    p = F.col("props")
    is_c = F.col("node_type") == "customer"
    return n.filter("graph_tag = 'kg'").select("node_id", F.when(is_c, p["segment"]).alias("segment"), F.when(is_c, p["nation"]).alias("nation"))


@query(f"WITH {GRAPH} SELECT DISTINCT source_id, relation_type, target_id FROM edges WHERE graph_tag IN ('kg', 'task_building')")
def merge_graph_edges(spark, sf):
    _, e = graph.merge_graph(nodes(spark, sf), edges(spark, sf), "task_building", "kg")
    return e.filter("graph_tag = 'kg'").select("source_id", "relation_type", "target_id")


@query(f"WITH {GRAPH} SELECT node_id AS source_id, '{S.DERIVED_FROM}' AS relation_type, 'region_ASIA' AS target_id FROM nodes WHERE graph_tag = 'task_building'")
def merge_graphs_star(spark, sf):
    return graph.star_edges(nodes(spark, sf).filter("graph_tag = 'task_building'"), "kg", "region_ASIA").select("source_id", "relation_type", "target_id")


@query(f"WITH {GRAPH}, e AS (SELECT graph_tag, count(*) AS n FROM edges GROUP BY 1) SELECT graph_tag, count(*) AS node_count, coalesce(any_value(e.n), 0) AS edge_count FROM nodes LEFT JOIN e USING (graph_tag) GROUP BY graph_tag")
def subgraph_stats(spark, sf):
    return graph.statistics(nodes(spark, sf), edges(spark, sf))


@query(f"""WITH {GRAPH} SELECT e.graph_tag, s.node_name AS source_name, relation_type, t.node_name AS target_name FROM edges e
JOIN nodes s ON s.graph_tag = e.graph_tag AND s.node_id = e.source_id JOIN nodes t ON t.graph_tag = e.graph_tag AND t.node_id = e.target_id""")
def pattern_edges(spark, sf):
    return graph.patterns(nodes(spark, sf), edges(spark, sf)).select("graph_tag", "source_name", "relation_type", "target_name")


@query(f"WITH {GRAPH} SELECT source_id, relation_type, target_id FROM edges WHERE graph_tag = 'task_machinery' ORDER BY 1, 2, 3 LIMIT 50")
def viz_sample(spark, sf):
    return graph.sample(nodes(spark, sf), edges(spark, sf), "task_machinery", 50)[1].select("source_id", "relation_type", "target_id")


@query(f"""WITH {GRAPH}, e AS (SELECT source_id, relation_type, target_id FROM edges WHERE graph_tag = 'task_machinery' ORDER BY 1, 2, 3 LIMIT 50)
SELECT node_id, node_name, node_type, CASE node_type WHEN 'customer' THEN 'nation,segment' ELSE 'code' END AS shown FROM nodes WHERE graph_tag = 'task_machinery' AND node_id IN (SELECT source_id FROM e UNION SELECT target_id FROM e)""")
def viz_nodes(spark, sf):
    n = graph.sample(nodes(spark, sf), edges(spark, sf), "task_machinery", 50)[0]
    n = n.withColumn("props", F.map_concat("props", F.create_map(F.lit("id"), F.lit("x"), F.lit("graph_tag"), F.lit("y"))))
    return graph.shown_nodes(n).select("node_id", "node_name", "node_type", F.array_join(F.array_sort(F.map_keys("props")), ",").alias("shown"))


@query(f"WITH {GRAPH} SELECT node_id, node_name FROM nodes WHERE graph_tag = 'kg' AND node_type = 'nation'")
def nodes_by_type(spark, sf):
    return graph.by_type(nodes(spark, sf), "kg", "nation").select("node_id", "node_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def export_page(spark, sf):
    return graph.page_after(table(spark, sf, "orders"), "o_orderkey", 1000, 100).select("o_orderkey", "o_custkey")


@query(f"WITH {GRAPH} SELECT row_number() OVER (ORDER BY graph_tag, node_id) - 1 AS node_id, '[\"' || graph_tag || '\"]' AS labels FROM nodes")
def export_nodes(spark, sf):
    return graph.export_nodes(nodes(spark, sf)).select("node_id", "labels")


@query(f"""WITH {GRAPH}, i AS (SELECT *, row_number() OVER (ORDER BY graph_tag, node_id) - 1 AS k FROM nodes), r AS (SELECT *, row_number() OVER (ORDER BY graph_tag, source_id, relation_type, target_id) - 1 AS rel_id FROM edges)
SELECT rel_id, s.k AS start_node_id, t.k AS end_node_id, relation_type AS type FROM r JOIN i s ON r.graph_tag = s.graph_tag AND source_id = s.node_id JOIN i t ON r.graph_tag = t.graph_tag AND target_id = t.node_id""")
def migrate_ids(spark, sf):
    return graph.export_edges(nodes(spark, sf), edges(spark, sf)).select("rel_id", "start_node_id", "end_node_id", "type")


@query(f"WITH {GRAPH} SELECT graph_tag, node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_tag = n.graph_tag AND n.node_id IN (source_id, target_id))")
def isolated_nodes(spark, sf):
    return graph.isolated(nodes(spark, sf), edges(spark, sf)).select("graph_tag", "node_id")


@query(f"""WITH {GRAPH}, c AS (SELECT graph_tag, source_id AS node_id FROM edges UNION SELECT graph_tag, target_id FROM edges), k AS (SELECT graph_tag, count(*) AS n FROM c GROUP BY 1)
SELECT graph_tag, count(*) AS total, coalesce(any_value(k.n), 0) AS connected FROM nodes LEFT JOIN k USING (graph_tag) GROUP BY graph_tag""")
def connectivity(spark, sf):
    n, e = nodes(spark, sf), edges(spark, sf)
    alone = graph.isolated(n, e).groupBy("graph_tag").agg(F.count("*").alias("a"))
    total = n.groupBy("graph_tag").agg(F.count("*").alias("total"))
    return total.join(alone, "graph_tag", "left").select("graph_tag", "total", (F.col("total") - F.coalesce("a", F.lit(0))).alias("connected"))


# fuzzy names


def _typos(spark, sf):
    """Every customer's name; of every third, a character is gone."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    at = (F.col("c_custkey") % 5 + 3).cast("int")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.substr("c_name", F.lit(1), at), F.substr("c_name", at + 2))).otherwise(F.col("c_name")).alias("target"))


FUZZY_SQL = """WITH less AS (SELECT c_custkey, unnest(list_transform(range(1, length(c_name) + 1), lambda i: substr(c_name, 1, i - 1) || substr(c_name, i + 1))) AS v FROM customer),
best AS (SELECT v, min(c_custkey) AS k FROM less GROUP BY v),
t AS (SELECT c_custkey, c_name, substr(c_name, 1, c_custkey % 5 + 3) || substr(c_name, c_custkey % 5 + 5) AS target, length(c_name) AS n FROM customer)
SELECT c_custkey, c_name AS target, c_name AS name, 1.0::DOUBLE AS score FROM t WHERE c_custkey % 3 <> 0
UNION ALL SELECT t.c_custkey, t.target, c.c_name, round(2.0 * (t.n - 1) / (2 * t.n - 1), 6)::DOUBLE FROM t JOIN best ON best.v = t.target JOIN customer c ON c.c_custkey = best.k WHERE t.c_custkey % 3 = 0"""


@query(FUZZY_SQL)
def fuzzy_best_match(spark, sf):
    t = _typos(spark, sf)
    names = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"))
    m = cluster.best_match(t, names)
    return t.join(m, "target").select("c_custkey", "target", "name", F.round("score", 6).alias("score"))


@query("SELECT c_custkey, substr(coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'S ' || c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN repeat('x', 40) END, ''), 1, 30) AS disambiguator FROM customer")
def disambiguator(spark, sf):
    k = F.col("c_custkey")
    p = F.create_map(F.lit("地区"), F.when(k % 2 == 0, F.concat(F.lit(" S "), "c_mktsegment", F.lit(" "))).otherwise(" "), F.lit("地址"), F.when(k % 3 == 0, F.repeat(F.lit("x"), 40)).otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", cluster.disambiguator(F.lit("公司"), p).alias("disambiguator"))


def _clustered(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(F.lit("part").alias("type"), F.col("p_name").alias("name"), F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string")).alias("props"), F.col("p_partkey").cast("long").alias("ord"))
    return cluster.clusters(rows)


@query()
def entity_clusters(spark, sf):
    return _clustered(spark, sf).select("type", "name", "ord", "cluster")


@query("""WITH n AS (SELECT p_brand, p_size AS v, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY ALL)
SELECT 'part' AS type, p_brand AS cluster, CAST(arg_min(v, (-n, f)) AS VARCHAR) AS value FROM n GROUP BY p_brand""")
def fuse_clusters(spark, sf):
    rows = table(spark, sf, "part").select(F.lit("part").alias("type"), F.col("p_brand").alias("cluster"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("props"), F.col("p_partkey").alias("ord"))
    return cluster.fuse_properties(rows).select("type", "cluster", "value")


@query("""WITH r AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand AS cluster, p_name AS name, n AS source_count, substr(md5('part_' || p_name), 1, 16) AS id FROM r WHERE k = 1""")
def fuse_names(spark, sf):
    rows = table(spark, sf, "part").select(F.lit("part").alias("type"), F.col("p_brand").alias("cluster"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return cluster.fuse(rows).select("cluster", "name", "source_count", "id")


# validation


@query("SELECT c_custkey, c_name AS name FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 5 <> 0")
def filter_invalid_entities(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", F.when(k % 4 != 0, F.col("c_name")).alias("name"), F.when(k % 5 == 0, "").otherwise("customer").alias("type"), F.lit(None).cast("map<string,string>").alias("props"))
    return merge.valid_entities(rows).filter("props is not null").select("c_custkey", "name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'by label' ELSE 'by type' END AS subject_type, 'nation' AS object_type FROM customer WHERE c_custkey % 7 <> 0")
def filter_invalid_relations(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", F.lit("in").alias("type"), F.when(k % 2 == 1, "by type").otherwise("").alias("subject_type"), F.lit("by label").alias("subject_label"), F.col("c_name").alias("subject_name"), F.lit("nation").alias("object_type"), F.lit(None).cast("string").alias("object_label"), F.when(k % 7 != 0, "x").alias("object_name"))
    return merge.valid_relations(rows).select("c_custkey", "subject_type", "object_type")


def _typed(spark, sf):
    """Relations with the types of their ends."""
    kind = entities(spark, sf).groupBy("name").agg(F.min("type").alias("t"))
    r = relations(spark, sf).join(kind.select(F.col("name").alias("source"), F.col("t").alias("subject_type")), "source").join(kind.select(F.col("name").alias("target"), F.col("t").alias("object_type")), "target")
    return r.select("type", "subject_type", F.col("source").alias("subject_name"), "object_type", F.col("target").alias("object_name"), "ord")


TYPED = "kinds AS (SELECT name, min(type) AS t FROM entities GROUP BY name), typed AS (SELECT r.type, s.t AS subject_type, r.source AS subject_name, o.t AS object_type, r.target AS object_name, r.ord FROM relations r JOIN kinds s ON s.name = r.source JOIN kinds o ON o.name = r.target)"


def _ontology(spark):
    return spark.sql("SELECT * FROM VALUES ('located in', 'customer', 'nation'), ('part of', 'nation', 'region'), ('supplied by', 'supplier', 'part') AS t(type, subject_type, object_type)")


@query(f"WITH {ENTITIES}, {RELATIONS}, {TYPED} SELECT type, subject_type, object_type, count(*) AS n FROM typed WHERE (type, subject_type, object_type) IN (('located in', 'customer', 'nation'), ('part of', 'nation', 'region'), ('supplied by', 'supplier', 'part')) GROUP BY ALL")
def schema_check(spark, sf):
    return merge.schema_check(_typed(spark, sf), _ontology(spark)).groupBy("type", "subject_type", "object_type").agg(F.count("*").alias("n"))


@query("SELECT n_name AS label, r_name AS source, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE '' END AS target FROM nation JOIN region ON n_regionkey = r_regionkey")
def ontology_projection(spark, sf):
    e = table(spark, sf, "nation").select(F.col("n_name").alias("label"), F.col("n_regionkey").alias("source"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).otherwise(-1).alias("target"))
    n = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label"))
    return merge.relation_schema(e, n)


@query(f"WITH {ENTITIES}, f AS (SELECT DISTINCT ON (type, name) type, name, value FROM props WHERE key = 'brand' ORDER BY type, name, ord), n AS (SELECT DISTINCT type, name FROM entities) SELECT n.type || '_' || n.name AS node_id, CASE WHEN n.type = 'part' THEN 2 ELSE 1 END AS n_props, f.value AS brand FROM n LEFT JOIN f USING (type, name)")
def field_whitelist(spark, sf):
    fields = spark.sql("SELECT * FROM VALUES ('part', array('brand', 'other')), ('supplier', array('none')) AS t(node_type, allowed)")
    out = merge.whitelist(nodes(spark, sf, False), fields)
    return out.select("node_id", F.size("props").alias("n_props"), F.col("props")["brand"].alias("brand"))


@query("SELECT 'part ' || p_partkey AS type, 'brand (STRING): of ' || p_brand || '|kind (STRING): ' AS attributes FROM part")
def entity_schema(spark, sf):
    p = table(spark, sf, "part")
    field = lambda name, said, k: F.struct(F.lit(name).alias("name"), said.alias("description"), F.lit(k).alias("ord"))
    none = F.lit(None).cast("string")
    rows = p.select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("type"), F.explode(F.array(field("nodeId", none, 0), field("brand", F.concat(F.lit("of "), "p_brand"), 1), field("kind", none, 2))).alias("x")).select("type", "x.*", F.lit("STRING").alias("kind"))
    return merge.entity_schema(rows).select("type", F.array_join("attributes", "|").alias("attributes"))


def _counted(spark, sf):
    mapping = entities(spark, sf).groupBy("type", "name").agg(F.min("ord").alias("o")).select("type", "name", fused_id(F.col("type"), F.col("name")).alias("id"))
    return merge.count_relations(merge.map_relations(_typed(spark, sf), mapping))


COUNTED = f"{ENTITIES}, {RELATIONS}, {TYPED}, counted AS (SELECT type, substr(md5(subject_type || '_' || subject_name), 1, 16) AS subject_id, substr(md5(object_type || '_' || object_name), 1, 16) AS object_id, count(*) AS n, min(ord) AS ord FROM typed GROUP BY ALL)"


@query(f"WITH {COUNTED} SELECT type, subject_id, object_id, n FROM counted")
def relation_counts(spark, sf):
    return _counted(spark, sf).select("type", "subject_id", "object_id", "n")


@query(f"WITH {COUNTED}, k AS (SELECT *, row_number() OVER (PARTITION BY subject_id, type ORDER BY n DESC, ord, object_id) AS k FROM counted) SELECT type, subject_id, object_id, n FROM k WHERE type <> 'supplied by' OR k = 1")
def single_value_constraint(spark, sf):
    return merge.single_valued(_counted(spark, sf), ["supplied by"]).select("type", "subject_id", "object_id", "n")


@query("SELECT type, count(*) AS rows, count(DISTINCT name) AS names FROM (SELECT 'part' AS type, p_name AS name FROM part UNION ALL SELECT 'supplier', s_name FROM supplier) GROUP BY type")
def dedup_sizes(spark, sf):
    return entities(spark, sf).filter("type in ('part', 'supplier')").groupBy("type").agg(F.count("*").alias("rows"), F.countDistinct("name").alias("names"))


@query(f"SELECT class, list_extract({graph.PALETTE!r}, CAST((dense_rank() OVER (ORDER BY class) - 1) % 10 + 1 AS INT)) AS colour FROM (SELECT DISTINCT p_brand AS class FROM part)")
def class_colors(spark, sf):
    return graph.class_colours(table(spark, sf, "part").select(F.col("p_brand").alias("class")))


