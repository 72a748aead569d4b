"""Exact nearest neighbours by a block matrix join (operator 3).

Vectors are scaled to unit length and quantised to int8, each with its own
step. Query blocks meet candidate blocks as tiles; a tile is one matrix product
of int8 values, and int8 values are all that travels to it. With unit vectors
x = a q + e and y = b r + f, the product a b (q . r) differs from x . y by at
most |e| |b r| + |f| |a q| + |e| |f|, so every tile gives an interval for each
cosine. A pair leaves a tile if its upper end reaches the k-th largest lower end
of its query there, and survives if it reaches the k-th largest of all tiles.
Only for survivors the original vectors are fetched, by a join, and cosines are
computed in double precision; a heap for each query merges them. No true
neighbour can be lost: recall is 1.

Of equal candidate vectors the k + 1 smallest ids take part, which is all that
any query can need of them; those that share a block form one column of it. Vectors that are
null, empty, zero, or hold a null or non-finite component take no part; nor do
null ids. Vectors of different length never meet. A repeated row counts once. An
id with several vectors stands for the nearest of them as a candidate, and for
the smallest, component by component, as a query. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, small_batches, table

QUERY_BLOCK = 1024
BLOCK = 4096
_EPS = 1e-9


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, v array<double>, dim) of the vectors that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))


def quantise(v: np.ndarray):
    """int8 values, step, bound of the error's length, length of the quantised vector."""
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    step = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / step[:, None])
    e = np.sqrt(((unit - q * step[:, None]) ** 2).sum(axis=1)) + _EPS
    return q.astype(np.int8), step, e, np.sqrt((q * q).sum(axis=1)) * step


def quantised(rows: DataFrame, n_blocks: int) -> DataFrame:
    """(dim, block, id, mark, q, step, err, len): int8 values as bytes, and a hash that equal vectors share."""
    small_batches(rows.sparkSession)
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block")
    names = ["dim", "block", "id", "mark", "q", "step", "err", "len"]

    def run(batches):
        for b in batches:
            v, dims = b.column(4), b.column(0).to_numpy()
            for d in np.unique(dims):
                own = b if (dims == d).all() else b.filter(pa.array(dims == d))
                flat = own.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                q, step, err, length = quantise(flat)
                raw = pa.array([x.tobytes() for x in q], pa.binary())
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(4)), raw, pa.array(step), pa.array(err), pa.array(length)], names=names)

    plain = rows.select("dim", block, "id", F.xxhash64("v").alias("mark"), "v")
    return plain.mapInArrow(run, "dim int, block int, id long, mark long, q binary, step double, err double, len double")


_PACKED = "dim int, block int, ids binary, marks binary, q binary, step binary, err binary, len binary"


def fewest(rows: DataFrame, copies: int) -> DataFrame:
    """Of equal vectors the rows with the ``copies`` smallest ids; each partition keeps no more before the shuffle."""
    order = Window.partitionBy("dim", "mark").orderBy("id")
    return rows.withColumn("_k", F.dense_rank().over(order)).filter(F.col("_k") <= copies).drop("_k")


def packed(rows: DataFrame) -> DataFrame:
    """One row a block; equal vectors stand together."""

    def pack(key, f):
        f = f.drop_duplicates(["id", "mark"]).sort_values(["mark", "id"], kind="stable")
        raw = lambda c: f[c].to_numpy().tobytes()
        return pd.DataFrame([{"dim": int(key[0]), "block": int(key[1]), "ids": raw("id"), "marks": raw("mark"), "q": b"".join(f["q"]), "step": raw("step"), "err": raw("err"), "len": raw("len")}])

    return rows.groupBy("dim", "block").applyInPandas(pack, _PACKED)


def tile(left, right, k: int):
    """(query, candidate, low, high) of the pairs of one tile that may be among the k nearest of their query there; a side: (ids, marks, int8 values, step, error, length)."""
    qi, _, q8, qs, qe, ql = left
    ci, marks, c8, cs, ce, cl = right
    starts = np.nonzero(np.append(True, marks[1:] != marks[:-1]))[0]  # equal vectors stand together
    ends = np.append(starts[1:], len(ci))
    exact = np.float32 if q8.shape[1] <= 1040 else np.float64  # sums of products of int8 values are whole numbers below 2^24
    columns, cs, ce, cl = c8[starts].astype(exact).T, cs[starts], ce[starts], cl[starts]
    out = []
    for a in range(0, len(qi), 256):
        b = min(a + 256, len(qi))
        near = (q8[a:b].astype(exact) @ columns).astype(np.float64) * qs[a:b, None] * cs
        slack = qe[a:b, None] * cl + ce * ql[a:b, None] + qe[a:b, None] * ce + _EPS
        low = near - slack
        want = min(k + 1, low.shape[1])  # the query itself may be among them
        bar = np.partition(low, low.shape[1] - want, axis=1)[:, low.shape[1] - want]
        row, col = np.nonzero(near + slack >= bar[:, None])
        n = ends[col] - starts[col]
        pair = np.repeat(np.arange(len(row)), n)
        which = starts[col][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        row, col = row[pair], col[pair]
        other = ci[which] != qi[a:b][row]
        out.append((qi[a:b][row][other], ci[which][other], low[row, col][other], (near + slack)[row, col][other]))
    return tuple(np.concatenate(x) for x in zip(*out))


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays of doubles, components summed in order."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, u: acc + u)
    return dot(x, y) / F.sqrt(dot(y, y) * dot(x, x))


def merged(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): heaps of k for each query, first of the rows of each partition, so that a query with many pairs does not meet in one task, then of what these keep."""

    def run(frames):
        heaps: dict[int, list[tuple[float, int]]] = {}
        for f in frames:
            for q, i, s in zip(f["query_id"].tolist(), f["vec_id"].tolist(), f["score"].tolist()):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapq.heapreplace(heap, (s, -i))
        rows = [(q, r, -i, s) for q, heap in heaps.items() for r, (s, i) in enumerate(sorted(heap, reverse=True), 1)]
        yield pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])

    schema = "query_id long, rank int, vec_id long, score double"
    return scored.mapInPandas(run, schema).repartition("query_id").mapInPandas(run, schema)


def nearest(queries: DataFrame, candidates: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest cosine for each query, itself left out."""
    c = usable(candidates, id_col, vec_col)
    q = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    q = materialise(q, "nearest-queries")
    nq, nc = max(1, -(-q.count() // query_block)), max(1, -(-c.count() // block))
    left = packed(quantised(q, nq)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    right = packed(fewest(quantised(c, nc), k + 1)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    l, r = left.alias("l"), right.alias("r")
    tiles = l.join(r, (F.col("l.dim") == F.col("r.dim")) & (F.col("l.block") == F.col("r.other")) & (F.col("l.other") == F.col("r.block")))
    parts = ["ids", "marks", "q", "step", "err", "len"]
    tiles = tiles.select(F.col("l.dim").alias("dim"), *[F.col(f"{s}.{p}").alias(f"{s}_{p}") for s in "lr" for p in parts])

    def run(frames):
        for f in frames:
            for t in f.to_dict("records"):
                side = lambda s: tuple(np.frombuffer(t[f"{s}_{p}"], dtype=kind) for p, kind in zip(parts, (np.int64, np.int64, np.int8, np.float64, np.float64, np.float64)))  # noqa: E731,B023
                (qi, qm, q8, *qr), (ci, cm, c8, *cr) = side("l"), side("r")
                found = tile((qi, qm, q8.reshape(-1, t["dim"]), *qr), (ci, cm, c8.reshape(-1, t["dim"]), *cr), k)
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "low", "high"), found)))

    found = tiles.mapInPandas(run, "query_id long, vec_id long, low double, high double")
    found = materialise(found.groupBy("query_id", "vec_id").agg(F.max("low").alias("low"), F.max("high").alias("high")), "nearest-pairs")
    lowest = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))).filter(F.col("n") <= k)
    bars = lowest.groupBy("query_id").agg(F.min("low").alias("bar"), F.max("n").alias("n"))
    alive = found.join(bars, "query_id").filter((F.col("high") >= F.col("bar")) | (F.col("n") < k)).select("query_id", "vec_id")
    alive = materialise(alive, "nearest-survivors")
    pairs = alive.join(c.select(F.col("id").alias("vec_id"), F.col("v").alias("y")), "vec_id").join(q.select(F.col("id").alias("query_id"), F.col("v").alias("x")), "query_id")
    scored = pairs.filter(F.size("x") == F.size("y")).select("query_id", "vec_id", cosine(F.col("x"), F.col("y")).alias("score"))
    return merged(scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)


def op3_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.filter("vec_id % 50 = 0"), rows, 5)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
