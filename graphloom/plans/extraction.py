"""Documents to graph: chunking, model, parsing, entities and relations, nodes and edges, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import is_blank
from ..operators import align, chunks, extract, merge
from ..session import materialise, use


def _texts(docs: DataFrame, id_col: str, text_col: str, most: int, overlap: int) -> DataFrame:
    """doc, route, chunk, text: long texts in overlapping paragraphs, short ones whole; blank ones not at all."""
    rows = docs.filter(~is_blank(F.col(text_col))).select(F.col(id_col).alias("doc"), F.col(text_col).alias("t"))
    rows = rows.withColumn("route", extract.route(F.col("t")))
    parts = F.when(F.col("route") == "oneshot", chunks.paragraph_chunks(F.col("t"), most, overlap)).otherwise(F.array("t"))
    return rows.select("doc", "route", F.posexplode(parts).alias("chunk", "text"))


def one_shot(rows: DataFrame, model: extract.Model, description: str, examples=()) -> DataFrame:
    """``rows`` (text, ...) with step "all", answer and error: entities and relations by one call."""
    asked = rows.withColumn("prompt", extract.prompt(F.col("text"), description, list(examples)))
    return extract.infer(asked.withColumn("step", F.lit("all")), model).drop("prompt")


def two_steps(rows: DataFrame, keys: list[str], model: extract.Model, entity_description: str, relation_description: str, *, entity_examples=(), relation_examples=(), fmt: str = "json") -> DataFrame:
    """``rows`` (keys, text, ...) twice, with step "entities" and "relations", answer and error.

    A call finds the entities of a text; a second one is told of them and finds
    their relations. A text without entities is not asked about again, and one
    without relations adds nothing; failed answers stay, as errors do.
    """
    asked = rows.withColumn("prompt", extract.prompt(F.col("text"), entity_description, list(entity_examples)))
    first = materialise(extract.infer(asked.withColumn("step", F.lit("entities")), model).drop("prompt"), "entities")
    bad = F.col("error").isNotNull() | extract.fault(extract.as_json(F.col("answer"), fmt)).isNotNull()
    named = extract.entities(extract.unnest(_usable(first, fmt), "answer", keys), allow_blank=False)
    told = named.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("extraction_index", F.concat(F.lit("- "), "class", F.lit(": "), "text").alias("s")))), lambda x: x["s"]), "\n").alias("_told"))
    again = first.join(told, keys).withColumn("prompt", extract.prompt(F.col("text"), relation_description, list(relation_examples), F.concat(F.lit("Entities\n"), "_told")))
    second = again.drop("answer", "error", "_told").withColumn("step", F.lit("relations"))
    second = materialise(extract.infer(second, model).drop("prompt"), "relations")
    related = extract.relations(extract.unnest(_usable(second, fmt), "answer", keys), keys).select(*keys).distinct()
    both = first.unionByName(second)
    return both.join(related, keys, "left_semi").unionByName(both.filter(bad).join(related, keys, "left_anti"))


def answers(docs: DataFrame, model: extract.Model, description: str, examples=(), *, relation_description: str | None = None, relation_examples=(), id_col: str = "doc_id", text_col: str = "text", most: int = 5_000, overlap: int = 500, fmt: str = "json") -> DataFrame:
    """doc, route, chunk, text, step, answer, error: long texts by one call for each chunk, short ones in two steps."""
    rows = _texts(docs, id_col, text_col, most, overlap)
    long = one_shot(rows.filter("route = 'oneshot'"), model, description, examples)
    short = two_steps(rows.filter("route = 'twostep'"), ["doc", "chunk"], model, description, relation_description or description, entity_examples=examples, relation_examples=relation_examples, fmt=fmt)
    return long.unionByName(short)


def _usable(found: DataFrame, fmt: str) -> DataFrame:
    plain = found.withColumn("answer", extract.as_json(F.col("answer"), fmt))
    return plain.filter(extract.fault(F.col("answer")).isNull())


def graph_of(found: DataFrame, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of answers (doc, chunk, answer; step, if there are several); answers that cannot be parsed add nothing. Fences around an answer do not count."""
    use(found.sparkSession)
    found = found if "step" in found.columns else found.withColumn("step", F.lit("all"))
    keys = ["doc", "chunk", "step"]
    items = extract.unnest(_usable(found.select(*keys, "answer"), fmt), "answer", keys)
    order = F.struct("doc", "chunk", "step", "extraction_index")
    named = extract.entities(items).filter((F.col("step") != "relations") & ((F.col("step") == "all") | (F.col("text") != "")))
    e = named.select(F.col("text").alias("name"), F.col("class").alias("type"), F.col("attributes").alias("props"), F.lit(None).cast("string").alias("description"), order.alias("ord"))
    r = extract.relations(items.filter("step <> 'entities'"), [*keys, "extraction_index"]).select("source", "type", "target", order.alias("ord"))
    nodes = merge.build_nodes(e)
    return nodes, merge.build_edges(r, nodes)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_type, node_count, edge_count (edges that leave nodes of the type)."""
    n = nodes.groupBy("node_type").agg(F.count("*").alias("node_count"))
    out = edges.join(nodes.select(F.col("node_id").alias("source_id"), "node_type"), "source_id").groupBy("node_type").agg(F.count("*").alias("edge_count"))
    return n.join(out, "node_type", "left").select("node_type", "node_count", F.coalesce("edge_count", F.lit(0).cast("long")).alias("edge_count"))


def annotate(docs: DataFrame, model: extract.Model, description: str, examples=(), *, id_col: str = "doc_id", text_col: str = "text", most: int = chunks.MAX_CHARS, passes: int = 1, fmt: str = "json") -> DataFrame:
    """document_id, text, extractions: sentence chunks, model, parsing, alignment moved to the document, passes merged without overlaps."""
    base = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text"))
    cut = chunks.sentence_chunks(base, "text", most)
    cut = cut.withColumn("prompt", extract.prompt(F.col("text"), description, list(examples)))
    parts = []
    for k in range(passes):
        got = extract.infer(cut, model).withColumn("answer", extract.as_json(F.col("answer"), fmt))
        items = extract.unnest(got, "answer", ["doc", "chunk_id"])
        lists = items.groupBy("doc", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("extraction_index", "class", "text", "group_index", F.to_json("attributes").alias("a")))).alias("x"))
        rows = cut.join(lists, ["doc", "chunk_id"]).withColumn("w", F.transform("x", lambda e: e["text"]))
        rows = align.align(rows, "text", "w", tok_offset="tok_start", char_offset="char_start")
        rows = rows.select("doc", "chunk_id", F.explode(F.arrays_zip("x", "aligned")).alias("z"))
        parts.append(rows.select("doc", "chunk_id", F.lit(k).alias("pass"), F.col("z.x.extraction_index").alias("idx"), F.col("z.x.group_index").alias("grp"), F.col("z.x.class").alias("cls"), F.col("z.x.text").alias("txt"), F.col("z.x.a").alias("a"), F.col("z.aligned.status").alias("status"), F.col("z.aligned.char_start").alias("start"), F.col("z.aligned.char_end").alias("end")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    kept = align.merge_passes(every, "doc", ["chunk_id", "idx"], "start", "end") if passes > 1 else every
    one = F.struct(
        F.col("cls").alias("extraction_class"), F.col("txt").alias("extraction_text"), F.when(F.col("status").isNotNull(), F.struct(F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))).alias("char_interval"),
        F.col("status").alias("alignment_status"), F.col("idx").alias("extraction_index"), F.col("grp").alias("group_index"), F.lit(None).cast("string").alias("description"), F.from_json("a", "map<string,string>").alias("attributes"),
    )
    lists = kept.groupBy("doc").agg(F.collect_list(F.struct("pass", "chunk_id", "idx", one.alias("e"))).alias("l"))
    ordered = F.transform(F.array_sort("l", lambda a, b: F.when(F.struct(a["pass"], a["chunk_id"], a["idx"]) < F.struct(b["pass"], b["chunk_id"], b["idx"]), -1).otherwise(1)), lambda x: x["e"])
    out = base.join(lists, "doc", "left").select(F.col("doc").alias("document_id"), "text", F.coalesce(ordered, F.array().cast(f"array<{S.EXTRACTION}>")).alias("extractions"))
    return out
