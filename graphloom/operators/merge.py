"""Merging of entities, nodes and relations under first-wins and last-wins rules.

Rows of one key may be most of all rows, so no rule collects them. Maps and sets
are taken apart, each entry is aggregated by itself, with partial aggregation in
every task, and what is put together at last has no more entries than the
merged value (:func:`gathered`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TEXT = "string"


def _entry(kind: str, name: Column, value: Column, place: Column) -> Column:
    return F.struct(F.lit(kind).alias("_kind"), name.cast(_TEXT).alias("_name"), value.cast(_TEXT).alias("_value"), place.cast("int").alias("_place"))


def gathered(rows: DataFrame, keys: list[str], order: str, *, first: bool = False, props: str | None = "props", sets: tuple[str, ...] = (), last: tuple[str, ...] = (), said: Column | None = None) -> DataFrame:
    """One row a key: ``ord``, the least order; ``props``, a map of all maps in which the last value of a name wins (the first, if ``first``); ``sets``, array columns united in the order of first sight; ``last``, the columns of the last row, nulls included; ``_said``, the last value of ``said`` that is not null."""
    empty = F.array().cast("array<struct<_kind:string,_name:string,_value:string,_place:int>>")
    lists = [F.array(_entry("row", F.lit(None), F.lit(None), F.lit(0)))]
    if props:
        lists.append(F.coalesce(F.transform(F.map_entries(props), lambda e: _entry("props", e["key"], e["value"], F.lit(0))), empty))
    placed = lambda c: F.transform(F.col(c), lambda x, i: _entry(c, x, F.lit(None), i))
    lists += [F.coalesce(placed(c), empty) for c in sets]
    carried = [F.col(order).alias("_o"), (F.struct(*last) if last else F.lit(None).cast(_TEXT)).alias("_last"), (said if said is not None else F.lit(None).cast(_TEXT)).alias("_text")]
    long = rows.select(*keys, *carried, F.explode(F.concat(*lists)).alias("_e")).select(*keys, "_o", "_last", "_text", "_e.*")
    pick = F.min_by if first else F.max_by
    spoken = F.when(F.col("_text").isNotNull(), F.col("_o"))
    one = long.groupBy(*keys, "_kind", "_name").agg(
        pick(F.struct("_value"), "_o").alias("_v"), F.min(F.struct("_o", "_place")).alias("_seen"), F.min("_o").alias("_least"), F.max("_o").alias("_most"), F.max_by("_last", "_o").alias("_last"), F.max_by("_text", spoken).alias("_text"), F.max(spoken).alias("_spoken")
    )
    entries = F.collect_list(F.struct("_kind", "_seen", "_name", F.col("_v._value").alias("_value")))
    of = lambda kind: F.filter("_all", lambda e: e["_kind"] == kind)
    out = one.groupBy(*keys).agg(F.min("_least").alias("ord"), F.array_sort(entries).alias("_all"), F.max_by("_last", "_most").alias("_last"), F.max_by("_text", "_spoken").alias("_said"))
    made = [F.map_from_entries(F.transform(of("props"), lambda e: F.struct(e["_name"], e["_value"]))).alias("props")] if props else []
    made += [F.transform(of(c), lambda e: e["_name"]).alias(c) for c in sets]
    return out.select(*keys, "ord", *([F.col("_last")[c].alias(c) for c in last]), *made, "_said")


def without_nulls(props: Column) -> Column:
    return F.map_filter(props, lambda k, v: v.isNotNull())


def exploded_winner(rows: DataFrame, keys: list[str], props: str, order: str, last_wins: bool = True) -> DataFrame:
    """keys, key, value: the winning value of every property key."""
    each = rows.select(*keys, F.col(order).alias("_o"), F.explode(props).alias("key", "value"))
    pick = F.max_by if last_wins else F.min_by
    return each.groupBy(*keys, "key").agg(pick(F.struct("value"), "_o").alias("_v")).select(*keys, "key", "_v.value")


def merge_entities(rows: DataFrame, order: str = "ord") -> DataFrame:
    """name, type, props (first wins; a present null blocks) of extraction entities, in the order of first sight."""
    return gathered(rows, ["name", "type"], order, first=True).select("name", "type", "ord", "props")


def distinct_relations(rows: DataFrame, keys=("source", "type", "target"), order: str = "ord") -> DataFrame:
    """The first row of each relation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def build_nodes(rows: DataFrame, order: str = "ord") -> DataFrame:
    """node_id, node_name, node_type, description, props: nulls pruned, last wins, the last description that is not empty."""
    said = F.when(F.coalesce("description", F.lit("")) != "", F.col("description"))
    made = rows.withColumn("props", without_nulls(F.col("props")))
    out = gathered(made, ["name", "type"], order, said=said)
    return out.select(F.col("name").alias("node_name"), F.col("type").alias("node_type"), "ord", "props", F.col("_said").alias("description"), F.concat_ws("_", "type", "name").alias("node_id"))


def resolve_endpoints(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations (source, type, target by name) with source_id and target_id: the first node of that name, whatever its type; unresolved ones go."""
    first = nodes.groupBy("node_name").agg(F.min_by("node_id", "ord").alias("node_id"))
    s = first.select(F.col("node_name").alias("source"), F.col("node_id").alias("source_id"))
    t = first.select(F.col("node_name").alias("target"), F.col("node_id").alias("target_id"))
    return relations.join(s, "source").join(t, "target")


def unresolved(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations of which an end is no node's name."""
    names = nodes.select("node_name").distinct().withColumn("_known", F.lit(True))
    side = lambda c: names.select(F.col("node_name").alias(c), F.col("_known").alias(f"_{c}"))
    out = relations.join(side("source"), "source", "left").join(side("target"), "target", "left")
    return out.filter(F.col("_source").isNull() | F.col("_target").isNull()).select(*relations.columns)


def build_edges(relations: DataFrame, nodes: DataFrame, order: str = "ord") -> DataFrame:
    """Edges of resolved relations, first wins."""
    found = resolve_endpoints(relations, nodes).withColumnRenamed("type", "relation_type")
    return distinct_relations(found, ("source_id", "relation_type", "target_id"), order)


def merge_nodes_across(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Nodes of several files by node_id: scalars of the last file, nulls included; properties last wins; file names united."""
    out = gathered(rows, ["node_id"], order, last=("node_name", "node_type", "description"), sets=("filename",))
    return out.select("node_id", "node_name", "node_type", "description", "props", F.sort_array("filename").alias("filename"))


def merge_edges_across(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Edges of several files: scalars of the last file, properties last wins."""
    keys = ["source_id", "target_id", "relation_type"]
    return gathered(rows, keys, order, last=("weight", "bidirectional")).select(*keys, "weight", "bidirectional", "props")


# relations that name typed entities


def map_relations(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """type, subject_id, object_id, ord: both ends replaced by the canonical id of (type, name); misses go."""
    s = mapping.select(F.col("type").alias("subject_type"), F.col("name").alias("subject_name"), F.col("id").alias("subject_id"))
    o = mapping.select(F.col("type").alias("object_type"), F.col("name").alias("object_name"), F.col("id").alias("object_id"))
    return relations.join(s, ["subject_type", "subject_name"]).join(o, ["object_type", "object_name"])


def count_relations(rows: DataFrame, order: str = "ord") -> DataFrame:
    """type, subject_id, object_id, n, ord of first sight."""
    return rows.groupBy("type", "subject_id", "object_id").agg(F.count("*").alias("n"), F.min(order).alias("ord"))


def single_valued(counted: DataFrame, types: list[str]) -> DataFrame:
    """Of the given relation types only the most frequent object of each subject, the first seen on ties."""
    w = Window.partitionBy("subject_id", "type").orderBy(F.desc("n"), "ord", "object_id")
    limited = counted.filter(F.col("type").isin(types)).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    return limited.unionByName(counted.filter(~F.col("type").isin(types)))


def valid_entities(rows: DataFrame) -> DataFrame:
    full = (F.coalesce("type", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "")
    return rows.filter(full).withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))


def valid_relations(rows: DataFrame) -> DataFrame:
    """Relations with all five fields; a type falls back to its label."""
    pick = lambda side: F.coalesce(F.nullif(F.col(f"{side}_type"), F.lit("")), F.nullif(F.col(f"{side}_label"), F.lit("")))
    out = rows.withColumn("subject_type", pick("subject")).withColumn("object_type", pick("object")).drop("subject_label", "object_label")
    for c in ("type", "subject_name", "object_name"):
        out = out.withColumn(c, F.nullif(F.col(c), F.lit("")))
    return out.dropna(subset=["type", "subject_type", "subject_name", "object_type", "object_name"])


def schema_check(relations: DataFrame, ontology: DataFrame) -> DataFrame:
    """Relations whose type is defined between their ends' types."""
    return relations.join(ontology.select("type", "subject_type", "object_type"), ["type", "subject_type", "object_type"], "left_semi")


def whitelist(nodes: DataFrame, fields: DataFrame, always=("name", "nodeName", "nodeId")) -> DataFrame:
    """Nodes with the properties that their type allows (fields: node_type, allowed array<string>), and nodeId."""
    allowed = F.concat(F.coalesce("allowed", F.array().cast("array<string>")), F.array(*map(F.lit, always)))
    kept = nodes.join(fields, "node_type", "left").withColumn("props", F.map_filter("props", lambda k, v: F.array_contains(allowed, k)))
    return kept.withColumn("props", F.map_concat("props", F.create_map(F.lit("nodeId"), F.col("node_id")))).drop("allowed")


def entity_schema(fields: DataFrame, system=("nodeId", "nodeName")) -> DataFrame:
    """type, attributes: "name (TYPE): description" of the fields (type, name, kind, description, ord) that are not the system's."""
    said = F.format_string("%s (%s): %s", "name", "kind", F.coalesce("description", F.lit("")))
    return fields.filter(~F.col("name").isin(list(system))).groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", said.alias("s")))), lambda x: x["s"]).alias("attributes"))


def relation_schema(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """label, source, target of ontology edges (label, source id, target id), ids replaced by labels; '' where missing."""
    name = lambda side: nodes.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"))
    out = edges.join(name("source"), "source", "left").join(name("target"), "target", "left")
    return out.select("label", F.coalesce("source_label", F.lit("")).alias("source"), F.coalesce("target_label", F.lit("")).alias("target"))
