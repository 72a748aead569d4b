"""Whole tasks: extraction into a graph, and merging of task graphs into a master graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import match_name, stem_of_file
from ..operators import catalog, cluster, extract, graph
from . import extraction


def _as_graph(nodes: DataFrame, edges: DataFrame, tag: str, level: str, filename: str | None) -> tuple[DataFrame, DataFrame]:
    graph.check_level(level, filename)
    files = F.array(F.lit(filename)) if filename else F.array().cast("array<string>")
    n = nodes.select(F.lit(tag).alias("graph_tag"), "node_id", "node_name", "node_type", "description", graph.clean_props(F.col("props")).alias("props"), files.alias("filename"), F.array(F.lit(level)).alias("graph_level"), "ord")
    e = edges.select(F.lit(tag).alias("graph_tag"), "source_id", "relation_type", "target_id", F.lit(1.0).alias("weight"), F.lit(False).alias("bidirectional"), F.create_map().cast("map<string,string>").alias("props"), files.alias("filename"), F.array(F.lit(level)).alias("graph_level"), "ord")
    return n, e


def run_task(docs: DataFrame, model: extract.Model, description: str, nodes: DataFrame, edges: DataFrame, tag: str, *, examples=(), level: str = "DomainLevel", filename: str | None = None, mode: str = "create_only", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents extracted into the graph ``tag``: (nodes, edges, rejected answers). A document that fails is a rejected row and stops nothing."""
    found = extraction.answers(docs, model, description, examples, id_col=id_col, text_col=text_col)
    got_n, got_e = extraction.graph_of(found)
    new_n, new_e = _as_graph(got_n, got_e, tag, level, filename)
    all_n = graph.upsert_nodes(nodes, new_n, mode)
    all_e = graph.upsert_edges(edges, new_e, all_n, mode)
    rejected = found.withColumn("fault", F.coalesce("error", extract.fault(extract.unfence(F.col("answer"))))).filter("fault is not null").select("doc", "chunk", "fault")
    return all_n, all_e, rejected


def task_result(nodes: DataFrame, edges: DataFrame, task_id: int, tag: str) -> DataFrame:
    """The result row that ``catalog.finish`` takes."""
    s = graph.statistics(nodes, edges).filter(F.col("graph_tag") == tag)
    total = s.agg(F.max("node_count").alias("n"), F.max("edge_count").alias("e"))
    return total.select(F.lit(task_id).cast("long").alias("id"), F.lit(True).alias("ok"), F.coalesce("n", F.lit(0)).alias("entities"), F.coalesce("e", F.lit(0)).alias("relations"))


def matches(tasks: DataFrame, nodes: DataFrame, master: str, node_type: str, threshold: float = 0.9) -> DataFrame:
    """id, name, node_id of completed tasks: the master node whose name is most like the task's; without a match the node is null, and the row says so."""
    ready = tasks.filter(catalog.can_merge(F.col("status")) & (F.col("del_flag") == 0)).select("id", "name", match_name(stem_of_file(F.col("name"))).alias("target"))
    of = graph.by_type(nodes, master, node_type)
    first = of.groupBy("node_name").agg(F.min("node_id").alias("node_id"))
    candidates = first.select(F.col("node_name").alias("name"), F.xxhash64("node_name").alias("ord"))
    found = cluster.best_match(ready.select("target"), candidates, threshold).select("target", F.col("name").alias("node_name"))
    out = ready.join(found, "target", "left").join(first, "node_name", "left")
    return out.select("id", "name", "node_id", F.when(F.col("node_id").isNull(), "no match").alias("error"))


def merge_matched(nodes: DataFrame, edges: DataFrame, source: str, master: str, matched_id: str) -> tuple[DataFrame, DataFrame]:
    """A task graph merged into the master, every node of it tied to the matched node."""
    all_n, all_e = graph.merge_graph(nodes, edges, source, master)
    own = graph.with_both_ends(edges.filter(F.col("graph_tag") == source), nodes)
    ends = own.select(F.col("source_id").alias("node_id")).union(own.select("target_id")).distinct()
    star = graph.star_edges(ends, master, matched_id, S.DERIVED_FROM)
    empty = F.array().cast("array<string>")
    star = star.select(*graph.EDGE_KEY, F.lit(1.0).alias("weight"), F.lit(False).alias("bidirectional"), F.create_map().cast("map<string,string>").alias("props"), empty.alias("filename"), empty.alias("graph_level"), F.lit(0).alias("ord"))
    return all_n, graph.upsert_edges(all_e, star, all_n, "create_only")


def merged(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """Tasks whose graph has been merged (ids: id)."""
    done = tasks.join(ids.select("id").distinct().withColumn("_done", F.lit(True)), "id", "left")
    return done.withColumn("status", F.when(F.col("_done"), S.MERGED).otherwise(F.col("status")).cast(tasks.schema["status"].dataType)).select(*tasks.columns)
