"""Session settings that the graph operators rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build(master: str = "local[*]", **more: str) -> SparkSession:
    b = SparkSession.builder.master(master)
    for k, v in {**SETTINGS, **more}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def use(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session made elsewhere."""
    for k in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        spark.conf.set(k, SETTINGS[k])
    return spark


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
