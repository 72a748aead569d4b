"""Property graphs as two tables, partitioned by graph tag: upserts, deletes, merges, reads and exports.

Every operation is a pure function from tables to tables; ``sources.store``
writes results. A node is keyed by (graph_tag, node_id), an edge by
(graph_tag, source_id, relation_type, target_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import property_name, relation_name
from .chunks import with_places
from .merge import gathered

NODE_KEY = ["graph_tag", "node_id"]
EDGE_KEY = ["graph_tag", "source_id", "relation_type", "target_id"]


def check_level(level: str, filename: str | None) -> None:
    if level not in S.LEVELS:
        raise ValueError(f"level must be one of {S.LEVELS}")
    if level == "DocumentLevel" and not filename:
        raise ValueError("DocumentLevel needs a file name")


def clean_props(props: Column) -> Column:
    """Properties under storable names; of names that become equal, the last wins."""
    return F.transform_keys(props, lambda k, v: property_name(k))


def append_if_absent(items: Column, x: Column) -> Column:
    return F.when(items.isNull(), F.array(x)).when(F.array_contains(items, x), items).otherwise(F.array_append(items, x))


def _upsert(existing: DataFrame, incoming: DataFrame, key: list[str], mode: str, order: str) -> DataFrame:
    """Rows of ``existing`` and ``incoming`` (with an order column) by key."""
    cols = existing.columns
    if mode == "create_only":
        rest = [c for c in cols if c not in key]
        new = incoming.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")
        return existing.unionByName(new.join(existing.select(*key), key, "left_anti").select(*cols))
    place = lambda known, o: F.struct(F.lit(known).alias("new"), o.cast(incoming.schema[order].dataType).alias("o"))  # noqa: E731  what exists comes first
    both = existing.withColumn("_o", place(0, F.lit(None))).unionByName(incoming.withColumn("_o", place(1, F.col(order))).select(*cols, "_o"))
    arrays = tuple(c for c in ("filename", "graph_level") if c in cols)
    scalars = tuple(c for c in cols if c not in key and c not in arrays and c != "props")
    return gathered(both, key, "_o", props="props" if "props" in cols else None, sets=arrays, last=scalars).select(*cols)


def upsert_nodes(existing: DataFrame, incoming: DataFrame, mode: str = "create_only", order: str = "ord") -> DataFrame:
    """create_only: nodes that exist stay as they are, the first of several new ones counts. overwrite: the last scalars and properties win, file names and levels are united."""
    return _upsert(existing, incoming, NODE_KEY, mode, order)


def upsert_edges(existing: DataFrame, incoming: DataFrame, nodes: DataFrame, mode: str = "create_only", order: str = "ord") -> DataFrame:
    """As for nodes; an edge needs both its ends among ``nodes``."""
    new = incoming.withColumn("relation_type", relation_name(F.col("relation_type")))
    return _upsert(existing, with_both_ends(new, nodes), EDGE_KEY, mode, order)


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select(*NODE_KEY).distinct()
    for side in ("source_id", "target_id"):
        edges = edges.join(ids.withColumnRenamed("node_id", side), ["graph_tag", side], "left_semi")
    return edges


def delete_graph(nodes: DataFrame, edges: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a tag go, with all their edges."""
    return nodes.filter(F.col("graph_tag") != tag), edges.filter(F.col("graph_tag") != tag)


def patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n)-[r]->(m): edges with both nodes of their tag."""
    side = lambda p: nodes.select("graph_tag", F.col("node_id").alias(f"{p}_id"), F.col("node_name").alias(f"{p}_name"), F.col("node_type").alias(f"{p}_type"))
    return edges.join(side("source"), ["graph_tag", "source_id"]).join(side("target"), ["graph_tag", "target_id"])


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_tag, node_count, edge_count."""
    n = nodes.groupBy("graph_tag").agg(F.count("*").alias("node_count"))
    e = with_both_ends(edges, nodes).groupBy("graph_tag").agg(F.count("*").alias("edge_count"))
    return n.join(e, "graph_tag", "left").select("graph_tag", "node_count", F.coalesce("edge_count", F.lit(0).cast("long")).alias("edge_count"))


def sample(nodes: DataFrame, edges: DataFrame, tag: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` edges of a tag, in key order, and the nodes that they join."""
    e = with_both_ends(edges.filter(F.col("graph_tag") == tag), nodes).orderBy(*EDGE_KEY[1:]).limit(limit)
    ends = e.select("graph_tag", F.col("source_id").alias("node_id")).union(e.select("graph_tag", "target_id")).distinct()
    return nodes.join(ends, NODE_KEY, "left_semi"), e


def shown_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes for display: properties without those that are columns of their own."""
    return nodes.withColumn("props", F.map_filter("props", lambda k, v: ~k.isin("id", "name", "graph_tag")))


def merge_graph(nodes: DataFrame, edges: DataFrame, source: str, target: str, *, include_isolated: bool = False) -> tuple[DataFrame, DataFrame]:
    """The graph of ``source`` copied into ``target``: properties of the source win, labels stay, edges carry their type only; isolated nodes stay behind unless asked for."""
    own_e = with_both_ends(edges.filter(F.col("graph_tag") == source), nodes)
    own_n = nodes.filter(F.col("graph_tag") == source)
    if not include_isolated:
        ends = own_e.select("graph_tag", F.col("source_id").alias("node_id")).union(own_e.select("graph_tag", "target_id")).distinct()
        own_n = own_n.join(ends, NODE_KEY, "left_semi")
    moved_n = own_n.withColumn("graph_tag", F.lit(target)).withColumn("ord", F.lit(0))
    all_n = upsert_nodes(nodes, moved_n, "overwrite")
    moved_e = own_e.withColumn("graph_tag", F.lit(target)).withColumn("props", F.create_map().cast("map<string,string>")).withColumn("ord", F.lit(0))
    return all_n, _upsert(edges, moved_e.select(*edges.columns, "ord"), EDGE_KEY, "overwrite", "ord")


def star_edges(nodes: DataFrame, target: str, matched_id: str, relation: str = S.DERIVED_FROM) -> DataFrame:
    """An edge from every merged node to the one that they were matched to."""
    return nodes.select(F.lit(target).alias("graph_tag"), F.col("node_id").alias("source_id"), F.lit(relation).alias("relation_type"), F.lit(matched_id).alias("target_id")).filter("source_id <> target_id")


def by_type(nodes: DataFrame, tag: str, type_: str) -> DataFrame:
    return nodes.filter((F.col("graph_tag") == tag) & (F.col("node_type") == type_))


def page_after(rows: DataFrame, key: str, last, n: int) -> DataFrame:
    """Keyset page: the ``n`` rows after key ``last``."""
    return rows.filter(F.col(key) > last).orderBy(key).limit(n)


def paged(rows: DataFrame, key: str, n: int, first=-1):
    """Keyset pages of ``n`` rows, to the last; each is a small plan of its own. A page's rows reach the driver."""
    last = first
    while True:
        page = page_after(rows, key, last, n).collect()
        if not page:
            return
        yield page
        last = page[-1][key]
        if len(page) < n:
            return


def with_internal_ids(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Rows numbered from 0 in key order, as an export or a migration names them."""
    return with_places(rows, order, out)


def export_nodes(nodes: DataFrame) -> DataFrame:
    """node_id, labels, properties as text."""
    n = with_internal_ids(nodes, NODE_KEY, "_id")
    return n.select(F.col("_id").alias("node_id"), F.to_json(F.array("graph_tag")).alias("labels"), F.to_json(F.map_concat(F.coalesce("props", F.create_map().cast("map<string,string>")), F.create_map(F.lit("id"), F.col("node_id"), F.lit("name"), F.col("node_name")))).alias("properties"))


def export_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rel_id, start_node_id, end_node_id, type, properties."""
    ids = with_internal_ids(nodes, NODE_KEY, "_id").select(*NODE_KEY, "_id")
    e = with_internal_ids(with_both_ends(edges, nodes), EDGE_KEY, "rel_id")
    e = e.join(ids.select("graph_tag", F.col("node_id").alias("source_id"), F.col("_id").alias("start_node_id")), ["graph_tag", "source_id"])
    e = e.join(ids.select("graph_tag", F.col("node_id").alias("target_id"), F.col("_id").alias("end_node_id")), ["graph_tag", "target_id"])
    return e.select("rel_id", "start_node_id", "end_node_id", F.col("relation_type").alias("type"), F.to_json("props").alias("properties"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge of their tag touches."""
    ends = edges.select("graph_tag", F.col("source_id").alias("node_id")).union(edges.select("graph_tag", "target_id")).distinct()
    return nodes.join(ends, NODE_KEY, "left_anti")


#: Colours of classes, in turn; fixed values.
PALETTE = ["#D2E3FC", "#C8E6C9", "#FEF0C3", "#F9DEDC", "#FFDDBE", "#EADDFF", "#C4E9E4", "#FCE4EC", "#E8EAED", "#DDE8E8"]


def class_colours(classes: DataFrame, col: str = "class") -> DataFrame:
    """class, colour, in the order of class names."""
    one = classes.select(col).distinct()
    rank = F.dense_rank().over(Window.orderBy(col)) - 1  # classes are few
    return one.withColumn("colour", F.element_at(F.array(*map(F.lit, PALETTE)), (rank % len(PALETTE) + 1).cast("int")))
