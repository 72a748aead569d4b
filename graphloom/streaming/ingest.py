"""Continuous ingest of a landing directory into the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landed(spark: SparkSession, path: str, glob: str = "*.{md,txt}") -> DataFrame:
    """A stream of file_name, text; every file once."""
    return spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", glob).format("text").load(path).select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("file_name"), F.col("value").alias("text"))


def ingest(docs: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Each micro-batch goes to ``handle`` (rows, batch id); an id that comes again is the same batch, so handlers can write by it."""
    w = docs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def progress(query: StreamingQuery) -> dict:
    return {"active": query.isActive, "last": query.lastProgress}
