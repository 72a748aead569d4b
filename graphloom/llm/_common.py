"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a temporary folder; a
    cluster session is an error, because its machines share no local folder.
    """
    global _local
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return _local


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives the optimiser true sizes,
    so that it broadcasts a side only if its files are below the threshold.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes, so that many long texts fit in a worker. Plans take the settings when they run, so they stay set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names) -> DataFrame:
    """``df`` less the columns an operator is about to add (any letter case)."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def joined_spans(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of (start, kind, end) structs, by start, then kind."""
    name = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"], x["end"])), ",")


def of_kind(spans: str, k: int) -> Column:
    """Number of spans of kind ``k``."""
    return F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
