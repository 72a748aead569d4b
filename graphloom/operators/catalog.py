"""Catalog of graphs, tasks and files: soft deletes, states, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def live(rows: DataFrame) -> DataFrame:
    return rows.filter("del_flag = 0")


def public(rows: DataFrame) -> DataFrame:
    """Rows as they are shown: ids as text, no null description, no null JSON."""
    out = rows
    for c in rows.columns:
        if c == "id" or c.endswith("_id"):
            out = out.withColumn(c, F.col(c).cast("string"))
        elif c == "description":
            out = out.withColumn(c, F.coalesce(c, F.lit("")))
        elif c in ("config", "graph_config", "parameters"):
            out = out.withColumn(c, F.coalesce(c, F.lit("{}")))
    return out


def named_like(rows: DataFrame, name: str | None, col: str = "name") -> DataFrame:
    """Rows whose name holds ``name``, in any letter case; all rows if there is no name."""
    return rows.filter(F.contains(F.lower(col), F.lit(name.lower()))) if name else rows


def page(rows: DataFrame, number: int = 1, size: int = 10, order: str = "id") -> DataFrame:
    return rows.orderBy(order).offset((number - 1) * size).limit(size)


def find(rows: DataFrame, **keys) -> DataFrame:
    """The live row with the given key values; none if there is no such row."""
    out = live(rows) if "del_flag" in rows.columns else rows
    for k, v in keys.items():
        out = out.filter(F.col(k) == v)
    return out.orderBy("id").limit(1)


def missing(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is new."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def can_delete(status: Column) -> Column:
    return status != S.RUNNING


def can_merge(status: Column) -> Column:
    return status == S.COMPLETED


def soft_delete(rows: DataFrame, which: Column) -> DataFrame:
    """``which`` rows are marked deleted, but those that run."""
    hit = which & can_delete(F.col("status")) if "status" in rows.columns else which
    return rows.withColumn("del_flag", F.when(hit, F.lit(1)).otherwise(F.col("del_flag")).cast(rows.schema["del_flag"].dataType))


def delete_cascade(graphs: DataFrame, tasks: DataFrame, files: DataFrame, which: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graphs and their tasks are marked deleted, files of these tasks are dropped."""
    gone = graphs.filter(which & (F.col("status") != S.RUNNING)).select(F.col("id").alias("kg_id"))
    marked = tasks.join(gone.withColumn("_gone", F.lit(True)), "kg_id", "left")
    tasks_out = marked.withColumn("del_flag", F.when(F.col("_gone") & can_delete(F.col("status")), 1).otherwise(F.col("del_flag")).cast(tasks.schema["del_flag"].dataType)).select(*tasks.columns)
    dropped = marked.filter(F.col("_gone") & can_delete(F.col("status"))).select(F.col("id").alias("task_id"))
    return soft_delete(graphs, which), tasks_out, files.join(dropped, "task_id", "left_anti").select(*files.columns)


def finish(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks after a run: ``results`` (id, ok, entities, relations). A task that had failed counts a retry."""
    out = tasks.join(results, "id", "left")
    ran = F.col("ok").isNotNull()
    new = {
        "status": F.when(F.col("ok"), S.COMPLETED).when(~F.col("ok"), S.FAILED).otherwise(F.col("status")),
        "entity_count": F.when(F.col("ok"), F.col("entities")).otherwise(F.col("entity_count")),
        "relation_count": F.when(F.col("ok"), F.col("relations")).otherwise(F.col("relation_count")),
        "retry_count": F.when(ran & (F.col("status") == S.FAILED), F.col("retry_count") + 1).otherwise(F.col("retry_count")),
    }
    return out.select(*[new[c].cast(tasks.schema[c].dataType).alias(c) if c in new else F.col(c) for c in tasks.columns])


def new_graph(rows: DataFrame) -> DataFrame:
    """Catalog rows of graphs (id, name, description) with their defaults."""
    given = {"id": F.col("id"), "name": F.col("name"), "description": F.col("description"), "graph_name": F.concat(F.lit("kg_"), F.col("id").cast("string"))}
    out = []
    for part in S.GRAPH.split(", "):
        c, t = part.split(" ")
        zero = F.lit(0) if t in ("int", "byte") else F.lit(None)
        out.append(given.get(c, zero).cast(t).alias(c))
    return rows.select(*out)


def new_tasks(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Task rows (id, kg_id, name, ...) that have a file, running, and the files of these tasks."""
    owned = files.filter(F.col("path").isNotNull())
    tasks = rows.join(owned.select(F.col("task_id").alias("id")).distinct(), "id", "left_semi")
    given = set(rows.columns)
    out = []
    for part in S.TASK.split(", "):
        c, t = part.split(" ")
        zero = F.lit(S.RUNNING if c == "status" else 0) if t in ("int", "byte") else F.lit(None)
        out.append((F.col(c) if c in given else zero).cast(t).alias(c))
    return tasks.select(*out), owned
