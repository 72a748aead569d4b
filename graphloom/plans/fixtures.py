"""The star schema as catalog rows, extraction rows and a property graph, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use

NO_STRINGS = "array<string>"


def line_id():
    """A line item's own number; (order, line) repeats in the tables."""
    return ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores, before work that is heavy for each row. Larger tables have them, and are not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


# catalog: customers are graphs, orders are tasks, line items are files


def graphs(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("description"), (F.col("c_nationkey") % 2).cast("byte").alias("status"), (F.col("c_custkey") % 10 == 0).cast("byte").alias("del_flag"))


def tasks(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(4)
    zero = F.lit(0).cast("int")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("kg_id"), F.concat(F.lit("task-"), F.col("o_orderkey").cast("string")).alias("name"), status.cast("byte").alias("status"), zero.alias("entity_count"), zero.alias("relation_count"), zero.alias("retry_count"), (F.col("o_orderkey") % 10 == 0).cast("byte").alias("del_flag"))


def files(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(line_id().alias("id"), F.col("l_orderkey").alias("task_id"), F.concat(F.lit("file-"), F.col("l_partkey").cast("string"), F.lit(".md")).alias("filename"))


GRAPHS = "graphs AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS description, c_nationkey % 2 AS status, CAST(c_custkey % 10 = 0 AS INT) AS del_flag FROM customer)"
TASKS = "tasks AS (SELECT o_orderkey AS id, o_custkey AS kg_id, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 4 END AS status, CAST(o_orderkey % 10 = 0 AS INT) AS del_flag FROM orders)"
FILES = "files AS (SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id, l_orderkey AS task_id, 'file-' || l_partkey || '.md' AS filename FROM lineitem)"

# extraction rows: entities repeat by name, relations by triple


def _props(**cols):
    return F.create_map(*[x for k, c in cols.items() for x in (F.lit(k), F.col(c).cast("string"))])


def entities(spark, sf):
    t = lambda n: table(spark, sf, n)
    one = lambda df, type_, name, order, **p: df.select(F.lit(type_).alias("type"), F.col(name).alias("name"), _props(**p).alias("props"), F.col(order).cast("long").alias("ord"))
    out = one(t("part"), "part", "p_name", "p_partkey", brand="p_brand", kind="p_type", size="p_size")
    out = out.unionByName(one(t("supplier"), "supplier", "s_name", "s_suppkey", nation="s_nationkey"))
    out = out.unionByName(one(t("customer"), "customer", "c_name", "c_custkey", segment="c_mktsegment"))
    out = out.unionByName(one(t("nation"), "nation", "n_name", "n_nationkey", region="n_regionkey"))
    return out.unionByName(one(t("region"), "region", "r_name", "r_regionkey", key="r_regionkey"))


ENTITIES = """props AS (
  SELECT 'part' AS type, p_name AS name, 'brand' AS key, p_brand AS value, p_partkey AS ord FROM part
  UNION ALL SELECT 'part', p_name, 'kind', p_type, p_partkey FROM part
  UNION ALL SELECT 'part', p_name, 'size', CAST(p_size AS VARCHAR), p_partkey FROM part
  UNION ALL SELECT 'supplier', s_name, 'nation', CAST(s_nationkey AS VARCHAR), s_suppkey FROM supplier
  UNION ALL SELECT 'customer', c_name, 'segment', c_mktsegment, c_custkey FROM customer
  UNION ALL SELECT 'nation', n_name, 'region', CAST(n_regionkey AS VARCHAR), n_nationkey FROM nation
  UNION ALL SELECT 'region', r_name, 'key', CAST(r_regionkey AS VARCHAR), r_regionkey FROM region),
entities AS (SELECT DISTINCT type, name, ord FROM props)"""


def relations(spark, sf):
    t = lambda n: table(spark, sf, n)
    n = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    cn = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("source"), F.lit("located in").alias("type"), F.col("n_name").alias("target"), F.col("c_custkey").cast("long").alias("ord"))
    sn = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("source"), F.lit("located in").alias("type"), F.col("n_name").alias("target"), F.col("s_suppkey").cast("long").alias("ord"))
    nr = n.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.lit("part of").alias("type"), F.col("r_name").alias("target"), F.col("n_nationkey").cast("long").alias("ord"))
    li = t("lineitem").select("l_partkey", "l_suppkey", line_id().alias("ord"))
    ps = li.join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    ps = ps.select(F.col("p_name").alias("source"), F.lit("supplied by").alias("type"), F.col("s_name").alias("target"), "ord")
    bad = t("region").select(F.lit("nobody").alias("source"), F.lit("part of").alias("type"), F.col("r_name").alias("target"), F.col("r_regionkey").cast("long").alias("ord"))
    return cn.unionByName(sn).unionByName(nr).unionByName(ps).unionByName(bad)


RELATIONS = """relations AS (
  SELECT c_name AS source, 'located in' AS type, n_name AS target, c_custkey AS ord FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_name, 'located in', n_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, 'part of', r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT p_name, 'supplied by', s_name, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT 'nobody', 'part of', r_name, r_regionkey FROM region)"""

# the stored graph: everything under the tag kg, customers once more under task_<segment>


def nodes(spark, sf, tags: bool = True):
    e = entities(spark, sf)
    arr = lambda *x: F.array(*map(F.lit, x)).cast(NO_STRINGS)
    cols = [F.concat_ws("_", "type", "name").alias("node_id"), F.col("name").alias("node_name"), F.col("type").alias("node_type"), F.lit(None).cast("string").alias("description")]
    base = e.groupBy("type", "name").agg(F.min_by("props", "ord").alias("props"))
    kg = base.select(F.lit("kg").alias("graph_tag"), *cols, "props", arr("kg.md").alias("filename"), arr("GlobalLevel").alias("graph_level"))
    if not tags:
        return kg
    c = table(spark, sf, "customer")
    tag = F.concat(F.lit("task_"), F.lower("c_mktsegment"))
    own = c.select(tag.alias("graph_tag"), F.concat(F.lit("customer_"), "c_name").alias("node_id"), F.col("c_name").alias("node_name"), F.lit("customer").alias("node_type"), F.lit("from a task").alias("description"), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.lit("?")).alias("props"), arr("task.md").alias("filename"), arr("DocumentLevel").alias("graph_level"))
    n = table(spark, sf, "nation")
    near = c.select(tag.alias("graph_tag"), "c_nationkey").distinct().join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    near = near.select("graph_tag", F.concat(F.lit("nation_"), "n_name").alias("node_id"), F.col("n_name").alias("node_name"), F.lit("nation").alias("node_type"), F.lit(None).cast("string").alias("description"), F.create_map(F.lit("code"), F.col("n_nationkey").cast("string")).alias("props"), arr("task.md").alias("filename"), arr("DocumentLevel").alias("graph_level"))
    return kg.unionByName(own).unionByName(near)


NODES = """nodes AS (
  SELECT DISTINCT 'kg' AS graph_tag, type || '_' || name AS node_id, name AS node_name, type AS node_type FROM entities
  UNION ALL SELECT 'task_' || lower(c_mktsegment), 'customer_' || c_name, c_name, 'customer' FROM customer
  UNION ALL SELECT DISTINCT 'task_' || lower(c_mktsegment), 'nation_' || n_name, n_name, 'nation' FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def edges(spark, sf, tags: bool = True):
    arr = F.array().cast(NO_STRINGS)
    ids = entities(spark, sf).select("name", F.concat_ws("_", "type", "name").alias("id")).groupBy("name").agg(F.min("id").alias("id"))
    r = relations(spark, sf).groupBy("source", "type", "target").agg(F.min("ord").alias("ord"))
    r = r.join(ids.select(F.col("name").alias("source"), F.col("id").alias("source_id")), "source").join(ids.select(F.col("name").alias("target"), F.col("id").alias("target_id")), "target")
    shape = lambda tag: [tag.alias("graph_tag"), "source_id", F.col("type").alias("relation_type"), "target_id", F.lit(1.0).alias("weight"), F.lit(False).alias("bidirectional"), F.create_map(F.lit("ord"), F.col("ord").cast("string")).alias("props"), arr.alias("filename"), arr.alias("graph_level")]
    kg = r.select(*shape(F.lit("kg")))
    if not tags:
        return kg
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).filter("c_custkey % 3 <> 0")
    own = c.select(F.concat(F.lit("task_"), F.lower("c_mktsegment")).alias("tag"), F.concat(F.lit("customer_"), "c_name").alias("source_id"), F.lit("located in").alias("type"), F.concat(F.lit("nation_"), "n_name").alias("target_id"), F.col("c_custkey").alias("ord"))
    return kg.unionByName(own.select(*shape(F.col("tag"))))


EDGES = """ids AS (SELECT name, min(type || '_' || name) AS id FROM entities GROUP BY name),
edges AS (
  SELECT 'kg' AS graph_tag, s.id AS source_id, r.type AS relation_type, t.id AS target_id
  FROM (SELECT DISTINCT source, type, target FROM relations) r JOIN ids s ON s.name = r.source JOIN ids t ON t.name = r.target
  UNION ALL SELECT 'task_' || lower(c_mktsegment), 'customer_' || c_name, 'located in', 'nation_' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0)"""
GRAPH = f"{ENTITIES},\n{RELATIONS},\n{NODES},\n{EDGES}"
