"""Identifiers: snowflakes, and node ids by type and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds of 2022-01-01, the first instant of a snowflake.
EPOCH = 1_640_995_200_000


def snowflake(ms: Column, machine: Column, seq: Column) -> Column:
    return F.shiftleft(ms - EPOCH, 22).bitwiseOR(F.shiftleft(machine.cast("long"), 12)).bitwiseOR(seq.cast("long"))


def snowflake_parts(id_: Column) -> Column:
    """struct(ms, machine, seq)."""
    return F.struct((F.shiftright(id_, 22) + EPOCH).alias("ms"), F.shiftright(id_, 12).bitwiseAND(F.lit(1023)).alias("machine"), id_.bitwiseAND(F.lit(4095)).alias("seq"))


def with_snowflakes(rows: DataFrame, ts: str, order: str, machine: int = 1, out: str = "snowflake") -> DataFrame:
    """Ids in the order of ``order`` within each millisecond; the 4,097th of one wraps into the next."""
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    n = F.row_number().over(Window.partitionBy(ms).orderBy(order)) - 1
    return rows.withColumn(out, snowflake(ms + F.floor(n / 4096), F.lit(machine), n % 4096))


def node_id(type_: Column, name: Column) -> Column:
    return F.concat_ws("_", type_, name)


def fused_id(type_: Column, name: Column) -> Column:
    """The first 16 hex digits of the MD5 of type_name."""
    return F.substring(F.md5(F.concat_ws("_", type_, name)), 1, 16)
