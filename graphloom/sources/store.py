"""Writers: versioned tables by graph tag, exports, annotated documents, batched sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(rows: DataFrame, root: str, *, by: str | None = "graph_tag") -> str:
    """A new version of a table, as a directory beside the others; returns its path. Readers of an older version are not disturbed."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    w = rows.write.option("compression", "zstd")
    (w.partitionBy(by) if by else w).parquet(path)
    return path


def read_version(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_csv(rows: DataFrame, path: str, delimiter: str = ",") -> None:
    """Header, quotes doubled; maps and arrays must be text already."""
    rows.write.option("header", True).option("sep", delimiter).option("escape", '"').option("quoteAll", True).csv(path)


def write_annotated(docs: DataFrame, path: str) -> None:
    """JSON lines of annotated documents: private columns and rows without an id are left out; none at all is an error."""
    named = docs.filter(F.col("document_id").isNotNull()).select(*[c for c in docs.columns if not c.startswith("_")])
    if named.isEmpty():
        raise ValueError("there are no documents to save")
    named.write.json(path)


def write_text(rows: DataFrame, path: str, col: str = "value") -> None:
    rows.select(F.col(col).cast("string").alias("value")).write.text(path)


def send(rows: DataFrame, put: Callable[[list[dict]], None], batch: int = 100) -> DataFrame:
    """Rows sent to an outer sink in batches; a batch that fails is sent row by row. Returns rejected rows as (row, error); a task that is run again sends again, so ``put`` must be idempotent."""
    import json

    import pandas as pd

    def run(frames):
        for f in frames:
            bad = []
            records = [json.loads(x) for x in f["row"]]
            for k in range(0, len(records), batch):
                part = records[k : k + batch]
                try:
                    put(part)
                except Exception:
                    for r in part:
                        try:
                            put([r])
                        except Exception as e:
                            bad.append((json.dumps(r, ensure_ascii=False), str(e)))
            yield pd.DataFrame(bad, columns=["row", "error"])

    return rows.select(F.to_json(F.struct("*")).alias("row")).mapInPandas(run, "row string, error string")


def create_tables(spark: SparkSession, schemas: dict[str, str]) -> None:
    for name, ddl in schemas.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet")


def drop_tables(spark: SparkSession, names) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def unique_names(rows: DataFrame, dir_col: str, name_col: str, order: str, out: str = "unique_name") -> DataFrame:
    """File names made unique in their directory: name.ext, name_1.ext, ..."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(dir_col, name_col).orderBy(order)) - 1
    stem, ext = F.regexp_replace(name_col, r"(?<=[^.])\.[^.]*$", ""), F.regexp_extract(name_col, r"(?<=[^.])(\.[^.]*)$", 1)
    return rows.withColumn(out, F.when(k == 0, F.col(name_col)).otherwise(F.concat(stem, F.lit("_"), k.cast("string"), ext)))


def healthy(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1").first()[0] == 1
