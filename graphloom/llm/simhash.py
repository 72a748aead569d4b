"""SimHash near-duplicate detection (operator 6).

Texts are lower-cased in A-Z, cut into words at ASCII white space, and hashed
by word shingles (XXH64, seed 42); a bit of the fingerprint is 1 if over half
the shingle hashes set it. Distinct fingerprints are joined by the binary trie
of :mod:`graphloom.llm.trie`; components of the links give the groups.

Null and empty texts have fingerprint zero and link like any other. Rows that
repeat share a fingerprint. A null doc_id counts as larger than any other; a
group of null ids only has a null component_id. Very long texts are hashed
whole, in bounded pieces. Exact copies meet as one fingerprint before the join.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import trie
from ._common import materialise, small_batches, table, without

SEED = 42
SHINGLE = 3
BITS = 2
_LAST = (1 << 63) - 1


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space are touched
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=len(words) - shingle + 1)


def _majority(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes set."""
    n = len(hashes)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 32_768):
        bits = np.unpackbits(hashes[k : k + 32_768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return _majority(_hashes(text, shingle))


def signature(text: str | None, shingle: int, words: int) -> list[int]:
    """``words`` fingerprints by independent hashes of the distinct shingles: their share of differing bits estimates the angle between shingle sets."""
    h = np.unique(_hashes(text, shingle))
    out = []
    for k in range(words):
        x = h ^ np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(x ^ (x >> np.uint64(31))))
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fp", *, shingle: int = SHINGLE, keep_text: bool = False) -> DataFrame:
    """Every row with its fingerprint as a signed long; the text goes unless kept."""
    small_batches(docs.sparkSession)
    source = without(docs, [out_col])
    kept = [f for f in source.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*kept, T.StructField(out_col, T.LongType())])
    names = {f.name for f in kept}

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i, f in enumerate(b.schema) if f.name in names), pa.array(prints.view(np.int64))], names=schema.names)

    return source.mapInArrow(run, schema)


def groups(prints: DataFrame, id_col: str = "doc_id", col: str = "fp", *, bits: int = BITS, leaf_rows: int = 200_000) -> DataFrame:
    """``prints`` (written, and small) with ``component_id``, the smallest id reachable over links of at most ``bits`` differing bits, and ``component_fp``, one fingerprint of the group."""
    least = F.min(F.coalesce(F.col(id_col), F.lit(_LAST)))
    one = materialise(prints.groupBy(F.col(col).alias("_fp")).agg(least.alias("_min")), "simhash-prints")
    edges = trie.links(one.select("_fp"), "_fp", bits, leaf_rows)
    roots = materialise(trie.components(edges, "simhash-links").select(F.col("v").alias("_fp"), F.col("root").alias("_root")), "simhash-roots")
    linked = one.join(roots, "_fp")
    smallest = linked.groupBy("_root").agg(F.min("_min").alias("_least"))
    moved = materialise(linked.join(smallest, "_root").select("_fp", "_root", "_least"), "simhash-moved")
    named = one.join(moved, "_fp", "left").select("_fp", F.coalesce("_least", "_min").alias("_least"), F.coalesce("_root", "_fp").alias("component_fp"))
    joined = prints.join(named, prints[col] == named["_fp"])
    return joined.select(*[prints[c] for c in prints.columns], F.nullif("_least", F.lit(_LAST)).alias("component_id"), "component_fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int = BITS, shingle: int = SHINGLE, leaf_rows: int = 200_000) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row."""
    prints = materialise(fingerprints(docs.select(id_col, text_col), text_col, "_print", shingle=shingle), "simhash-docs")
    found = groups(prints, id_col, "_print", bits=bits, leaf_rows=leaf_rows)
    return found.select(id_col, F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies of whole texts: word shingles, least Jaccard similarity, words of a signature, words that admit a candidate, share of pairs of exactly that similarity that the tries may overlook.
NEAR_SHINGLE, SIMILARITY, WORDS, CHECK, MISS = 5, 0.8, 6, 3, 0.001
#: Rows of candidates that meet in one task.
MEET = 20_000


def differing_share(similarity: float) -> float:
    """Chance that a bit differs between the signatures of two sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def differing_bits(similarity: float, bits: int, slack: float = 5.4) -> int:
    """Bits in which signatures of two sets of this Jaccard similarity differ at most, ``slack`` standard deviations over the mean."""
    p = differing_share(similarity)
    return int(bits * (p + slack * math.sqrt(p * (1 - p) / bits)))


def signatures(docs: DataFrame, text_col: str, words: list[str], *, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """Every row, text kept, with its signature in ``words``."""
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(w, T.LongType()) for w in words]])

    def run(batches):
        for b in batches:
            found = np.array([signature(t.as_py(), shingle, len(words)) for t in b.column(b.schema.get_field_index(text_col))], dtype=np.uint64).reshape(-1, len(words)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(words)))], names=schema.names)

    return docs.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, text_col: str, out_col: str, *, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """Every row with the distinct hashes of its text's shingles (binary, 8 bytes each) in place of the text."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField(out_col, T.BinaryType())])

    def run(batches):
        for b in batches:
            found = [np.unique(_hashes(t.as_py(), shingle)).tobytes() for t in b.column(b.schema.get_field_index(text_col))]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(found, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the first one that it reaches over pairs whose Jaccard similarity is at least ``similarity``.

    A set that is reached is compared with those that are not reached yet, so
    copies of one text cost one comparison each.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    root = np.where(size > 0, -1, np.arange(n))
    rest = np.nonzero(size)[0]
    if not len(rest):
        return root
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    ends = np.cumsum(size)
    mark = np.zeros(int(codes.max()) + 1, dtype=bool)
    flat, starts = codes, (ends - size)[rest]
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first], queue = first, [first]
        while queue:
            d = queue.pop()
            open_ = root[rest] < 0
            if not open_.any():
                return root
            if 2 * open_.sum() < len(rest):
                flat = flat[np.repeat(open_, size[rest])]
                rest = rest[open_]
                starts = np.cumsum(size[rest]) - size[rest]
                open_ = np.ones(len(rest), dtype=bool)
            own = codes[ends[d] - size[d] : ends[d]]
            mark[own] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = False
            new = rest[open_ & (both >= similarity * (size[d] + size[rest] - both) - 1e-9)]
            root[new] = first
            queue += new.tolist()
    return root


def in_parts(members: DataFrame, id_col: str, root_col: str, most: int = MEET) -> DataFrame:
    """``members`` with ``_pair``: a group over ``most`` rows is cut into parts, and a row is repeated for every two parts of which one is its own."""
    size = members.groupBy(root_col).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
    rows = members.join(size, root_col).withColumn("_part", F.pmod(F.xxhash64(id_col), F.col("_parts")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return rows.withColumn("_pair", F.struct(F.least("_part", "_other").alias("a"), F.greatest("_part", "_other").alias("b"))).drop("_parts", "_part", "_other")


def confirmed(sets: DataFrame, id_col: str, root_col: str, set_col: str, similarity: float) -> DataFrame:
    """Edges (u, v) that connect the rows of each group of candidates (``root_col``, ``_pair``) as all pairs of at least this Jaccard similarity do."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column(id_col).to_numpy()
        order = np.argsort(ids)
        found = t.column(set_col).to_pylist()
        root = alike([np.frombuffer(found[k], dtype=np.uint64) for k in order], similarity)
        ids, moved = ids[order], np.nonzero(root != np.arange(len(root)))[0]
        return pa.table({"u": pa.array(ids[moved], pa.int64()), "v": pa.array(ids[root[moved]], pa.int64())})

    return sets.groupBy(root_col, "_pair").applyInArrow(run, "u long, v long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE, miss: float = MISS, meet: int = MEET) -> DataFrame:
    """``docs`` less all but one row of each group of near copies: the row with the smallest id stays (null last; of rows that repeat it, one).

    Rows are near copies if the sets of their word shingles (as 64-bit hashes)
    have the given Jaccard similarity. Tries over fingerprints that are drawn
    from a longer signature propose candidates. Groups are what such rows
    connect, and inside a group the sets themselves are compared; a group over
    ``meet`` rows is compared part by part.
    """
    names = [f"_c{k}" for k in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    words = [f"_w{k}" for k in range(WORDS)]
    stored = materialise(signatures(plain, at[text_col], words, shingle=shingle).withColumn("_row", F.monotonically_increasing_id()), "simhash-rows")
    order = F.struct(F.coalesce(F.col(at[id_col]).cast("long"), F.lit(_LAST)).alias("i"), F.col("_row").alias("r"))
    one = stored.groupBy(*words).agg(F.min(order).alias("_first"), F.min("_row").alias("_id"))
    one = materialise(one, "simhash-signatures")
    edges = trie.similar(one, "_id", words, p=differing_share(similarity), miss=miss, check=CHECK, within=differing_bits(similarity, 64 * CHECK))
    loose = trie.components(edges, "simhash-near").select("v", F.col("root").alias("_near"))
    members = in_parts(loose, "v", "_near", meet)
    texts = stored.select("_row", F.col(at[text_col]).alias("_text"))
    sets = shingle_sets(texts.join(loose.select("v"), texts["_row"] == loose["v"]).drop("v"), "_text", "_set", shingle=shingle)
    exact = confirmed(members.join(materialise(sets, "simhash-sets"), F.col("v") == F.col("_row")).select("_row", "_near", "_pair", "_set"), "_row", "_near", "_set", similarity)
    roots = materialise(trie.components(exact, "simhash-exact").select(F.col("v").alias("_id"), "root"), "simhash-roots")
    group = one.select("_id", "_first").join(roots, "_id", "left").groupBy(F.coalesce("root", "_id").alias("_g")).agg(F.min("_first").alias("_first"))
    kept = group.select(F.col("_first.r").alias("_row"))
    gone = materialise(stored.select("_row").join(kept, "_row", "left_anti"), "simhash-gone")
    return stored.join(gone, "_row", "left_anti").select(*[F.col(n).alias(c) for c, n in at.items()])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
