"""Sharding by sampled splitters (operator 9), with DataFrame functions only.

Records are ordered by (hash of the text, hash of the id, row number), so equal
texts are neighbours and yet a group of copies can be cut anywhere. A sample of
keys, drawn with a chance in proportion to size, gives weighted quantiles: the
boundaries of many ranges, each a small part of a shard. Ranges that turn out
overfull are sampled again and subdivided, until none is that holds two rows
(a range between two keys is of one row, so this ends). Exact sums of the ranges, and running
sums within each, place every record on a line of all bytes; equal stretches of
the line are the shards.

The law is ``bytes``: the sizes of any two shards differ by less than two of
the largest records. A null text has no bytes; its checksum is that of the
empty text. Repeated rows and null ids are records like any other. What reaches
the driver is bounded by ``MOST`` ranges and what subdivides them, at most twice
as many, not by the rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, table

SHARDS = 24
RANGES = 512
#: Rows aimed at in a range, and the most ranges before subdivision.
ROWS = 50_000
MOST = 16_384
#: Sampled keys for each range.
DRAW = 8
#: Times the mean bytes or rows from which a range is overfull.
OVERFULL = 4
_COARSE = 12


def _numbers(values, kind: str) -> Column:
    """A constant array, parsed once when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _coarse(k1: int) -> int:
    return ((k1 + (1 << 63)) >> (64 - _COARSE)) & ((1 << _COARSE) - 1)


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """Number of splitters that are at most a row's key. Only those with the key's leading bits are compared."""
    if not splitters:
        return F.lit(0)
    start = [0] * ((1 << _COARSE) + 1)
    for s in splitters:
        start[_coarse(s[0]) + 1] += 1
    for k in range(1 << _COARSE):
        start[k + 1] += start[k]
    at = F.shiftrightunsigned(F.col("k1").bitwiseXOR(F.lit(-(1 << 63))), 64 - _COARSE).cast("int")
    lo, hi = _numbers(start[:-1], "int")[at], _numbers(start[1:], "int")[at]
    a, b, c = (_numbers([s[k] for s in splitters], "bigint") for k in range(3))
    at_most = lambda i: (a[i] < F.col("k1")) | ((a[i] == F.col("k1")) & ((b[i] < F.col("k2")) | ((b[i] == F.col("k2")) & (c[i] <= F.col("uid")))))
    return lo + F.when(hi > lo, F.size(F.filter(F.sequence(lo, hi - 1), at_most))).otherwise(0)


def _draw(rows: DataFrame, salt: int, rate: Column) -> list[tuple[tuple[int, int, int], float]]:
    """Sampled (key, weight), in order; ``rate`` is the expected number of draws of a row."""
    u = F.shiftrightunsigned(F.xxhash64("k1", "k2", "uid", F.lit(salt)), 11) / F.lit(float(1 << 53))
    found = rows.withColumn("_rate", rate).filter(u < F.col("_rate")).select("k1", "k2", "uid", F.greatest("_rate", F.lit(1.0)).alias("w")).collect()
    return sorted(((r.k1, r.k2, r.uid), r.w) for r in found)


def _quantiles(drawn, parts: int) -> list[tuple[int, int, int]]:
    total, run, out = sum(w for _, w in drawn), 0.0, []
    for key, w in drawn:
        if run >= (len(out) + 1) * total / parts:
            out.append(key)
        run += w
    return out


def assign(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, *, ranges: int = RANGES) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = records.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("k1"), F.xxhash64(F.col(id_col)).alias("k2"), F.monotonically_increasing_id().alias("uid"))
    base = materialise(base, "shard-keys")
    whole = base.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    n, total = whole.n, whole.b or 1
    parts = max(1, min(MOST, n, max(ranges, n // ROWS)))
    splitters = _quantiles(_draw(base, 0, F.col("size") * (parts * DRAW / total)), parts)
    sums: dict[int, tuple[int, int]] = {}
    salt = 0
    while True:
        salt += 1
        ranged = base.withColumn("range", _range_of(splitters))
        sums = {r.range: (r.n, r.b) for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
        mean_n, mean_b = max(1, n / parts), max(1, total / parts)
        over = {k: max(c / mean_n, b / mean_b) for k, (c, b) in sums.items() if c > 1 and max(c / mean_n, b / mean_b) > OVERFULL}
        if not over:
            break
        rate = [min(1.0, DRAW * over[k] / sums[k][0]) if k in over else 0.0 for k in range(len(splitters) + 1)]  # draws a row, by range
        drawn = _draw(ranged, salt, _numbers(rate, "double")[F.col("range")])
        more, seen, per, known = set(), Counter(), max(1, DRAW // 2), set(splitters)
        for key, _ in drawn:
            if key in known:
                continue
            k = bisect_right(splitters, key)
            if seen[k] % per == 0:
                more.add(key)
            seen[k] += 1
        if not more:
            break  # every key that was drawn is a boundary
        splitters = sorted({*splitters, *more})
    last = max(sums, default=0)
    bytes_before, rows_before = [0] * (last + 1), [0] * (last + 1)
    b = c = 0
    for k in range(last + 1):
        bytes_before[k], rows_before[k] = b, c
        c, b = c + sums.get(k, (0, 0))[0], b + sums.get(k, (0, 0))[1]
    order = Window.partitionBy("range").orderBy("k1", "k2", "uid")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + _numbers(bytes_before, "bigint")[F.col("range")]
    row = F.row_number().over(order) - 1 + _numbers(rows_before, "bigint")[F.col("range")]
    placed = base.withColumn("range", _range_of(splitters)).withColumn("before", before).withColumn("row", row)
    middle = F.floor((2 * F.col("before") + F.col("size")).cast("decimal(38,0)") * shards / (2 * total))
    placed = placed.select("id", "size", "crc", "row", F.least(F.lit(shards - 1), middle.cast("int")).alias("shard"))
    placed = materialise(placed, "shard-rows")
    starts = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("row").alias("first")).collect()}  # a row a shard
    first = _numbers([starts.get(k, 0) for k in range(shards)], "bigint")
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - first[F.col("shard")]).alias("slot"))


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
