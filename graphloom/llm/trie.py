"""Self-join of fingerprints within a Hamming distance by a binary trie, and connected components.

A sorted array of distinct fingerprints is a binary trie: a node is a range of
the array whose values share a prefix. Two nodes are traversed together; the
children of a pair inherit its differing bits, plus one where the branches
part, and a pair whose bits exceed the budget is pruned with all below it.

Across machines, the leaves of an adaptive trie over the first 16 bits deal out
the work: each fingerprint is at home in one leaf and visits those earlier
leaves whose prefix is within the budget of its own. A leaf over the row target
is split further; where one prefix is crowded by itself, its rows are cut into
parts and every two parts meet in a task of their own, so no task grows with
the crowd. A task's links are returned as a spanning forest (each fingerprint
to the smallest one it reaches), which keeps every connection and is never
larger than the task's rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise

_PAIRS = 1 << 18  # node pairs, and fingerprint pairs, that are expanded at once
_SMALL = 8  # node pairs with at most so many fingerprint pairs are compared outright
PREFIX = 16


def _expand(a0, a1, b0, b1):
    """All index pairs of each range pair."""
    nb = b1 - b0
    n = (a1 - a0) * nb
    ends = np.cumsum(n)
    which = np.repeat(np.arange(len(n)), n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    return a0[which] + at // nb[which], b0[which] + at % nb[which]


def close_pairs(left: np.ndarray, right: np.ndarray | None, budget: int, levels: int = 64, exact: int = 0):
    """Index pairs of sorted uint64 arrays within ``budget`` bits, in chunks; ``right`` None joins ``left`` with itself, each pair once.

    Values differ in their first ``levels`` bits only. The first ``exact`` bits of a pair must be equal.
    """
    own = right is None
    right = left if own else right
    if not len(left) or not len(right):
        return
    if exact and own:
        head = left >> np.uint64(64 - exact)
        edge = np.concatenate([[0], np.nonzero(head[1:] != head[:-1])[0] + 1, [len(left)]]).astype(np.int64)
        start = [edge[:-1], edge[1:], edge[:-1], edge[1:], np.zeros(len(edge) - 1, dtype=np.int64)]
    else:
        start = [np.array([x], dtype=np.int64) for x in (0, len(left), 0, len(right), 0)]
    stack = [(exact if own else 0, start)]
    while stack:
        depth, (a0, a1, b0, b1, bits) = stack.pop()
        if len(a0) > _PAIRS:
            for k in range(0, len(a0), _PAIRS):
                stack.append((depth, [x[k : k + _PAIRS] for x in (a0, a1, b0, b1, bits)]))
            continue
        size = (a1 - a0) * (b1 - b0)
        small = (size <= _SMALL) | (depth == levels)
        if small.any():
            ranges = [x[small] for x in (a0, a1, b0, b1)]
            order = np.cumsum(size[small]) // _PAIRS  # equal values make large ranges: expanded in parts
            for part in np.unique(order):
                for i, j in _parts(*(x[order == part] for x in ranges)):
                    hit = np.bitwise_count(left[i] ^ right[j]) <= budget
                    if own:
                        hit &= i < j
                    if hit.any():
                        yield i[hit], j[hit]
            a0, a1, b0, b1, bits = (x[~small] for x in (a0, a1, b0, b1, bits))
        if not len(a0):
            continue
        low = np.uint64(63 - depth)
        keep = np.uint64(0 if depth == 0 else (0xFFFFFFFFFFFFFFFF << (64 - depth)) & 0xFFFFFFFFFFFFFFFF)
        one = np.uint64(1) << low
        am = np.searchsorted(left, (left[a0] & keep) | one)
        bm = np.searchsorted(right, (right[b0] & keep) | one)
        other = ~((a0 == b0) & (a1 == b1) & own)
        parts = [(a0, am, b0, bm, bits), (am, a1, bm, b1, bits), (a0, am, bm, b1, bits + 1)]
        parts.append(tuple(x[other] for x in (am, a1, b0, bm, bits + 1)))
        after = [np.concatenate(x) for x in zip(*parts)]
        live = (after[0] < after[1]) & (after[2] < after[3]) & (after[4] <= budget)
        stack.append((depth + 1, [x[live] for x in after]))


def _parts(a0, a1, b0, b1):
    """Index pairs of ranges; a single pair of large ranges comes in slices."""
    if len(a0) > 1 or (a1[0] - a0[0]) * (b1[0] - b0[0]) <= _PAIRS:
        yield _expand(a0, a1, b0, b1)
        return
    step = max(1, int(_PAIRS // (b1[0] - b0[0])))
    for k in range(int(a0[0]), int(a1[0]), step):
        yield _expand(np.array([k]), np.minimum(np.array([k + step]), a1), b0, b1)


class Labels:
    """Smallest index that each of n items is linked to, directly or not."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.pending, self.size = [], 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.pending.append((u, v))
        self.size += len(u)
        if self.size > 4 * _PAIRS:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.pending:
            u, v = (np.concatenate(x) for x in zip(*self.pending))
            self.pending, self.size = [], 0
            while True:
                lu, lv = self.of[u], self.of[v]
                differ = lu != lv
                if not differ.any():
                    break
                u, v, lu, lv = u[differ], v[differ], lu[differ], lv[differ]
                parent = np.arange(len(self.of))
                np.minimum.at(parent, np.maximum(lu, lv), np.minimum(lu, lv))
                while not ((up := parent[parent]) == parent).all():
                    parent = up
                self.of = parent[self.of]
        return self.of


def forest(home: np.ndarray, visitors: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest fingerprint that it reaches by links within a leaf)."""
    values = np.sort(np.concatenate([home, visitors]))
    at_home, at_visit = np.searchsorted(values, home), np.searchsorted(values, visitors)
    labels = Labels(len(values))
    for i, j in close_pairs(home, None, budget):
        labels.add(at_home[i], at_home[j])
    for i, j in close_pairs(home, visitors, budget):
        labels.add(at_home[i], at_visit[j])
    of = labels.settle()
    moved = of != np.arange(len(values))
    return values[moved], values[of[moved]]


def leaves(counts: dict[int, int], most: int) -> np.ndarray:
    """Leaf of each of the 2^16 prefixes: ranges halved while they hold over ``most`` fingerprints."""
    total = np.zeros((1 << PREFIX) + 1, dtype=np.int64)
    for p, n in counts.items():
        total[p + 1] += n
    total = np.cumsum(total)
    out, n, stack = np.zeros(1 << PREFIX, dtype=np.int32), 0, [(0, 1 << PREFIX)]
    while stack:
        a, b = stack.pop()
        if b - a > 1 and total[b] - total[a] > most:
            stack += [((a + b) // 2, b), (a, (a + b) // 2)]
        else:
            out[a:b] = n
            n += 1
    return out


def _split(counts: dict[int, int], most: int) -> dict[int, int]:
    """Parts of the groups that hold over ``most`` rows."""
    return {g: -(-n // most) for g, n in counts.items() if n > most}


def _spread(group: np.ndarray, salt: np.ndarray, parts: dict[int, int]):
    """(row, group, pair) of all tasks: a group in parts has a task for each two of them, and a row goes to those of its own part."""
    row, pair = np.arange(len(group)), np.zeros(len(group), dtype=np.int64)
    if not parts:
        return row, group, pair
    hot = np.isin(group, np.fromiter(parts, dtype=np.int64, count=len(parts)))
    out = [(row[~hot], group[~hot], pair[~hot])]
    for g in np.unique(group[hot]):
        c, own = parts[int(g)], np.nonzero(group == g)[0]
        part = (salt[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % c
        for other in range(c):
            out.append((own, group[own], np.minimum(part, other) * c + np.maximum(part, other)))
    return tuple(np.concatenate(x) for x in zip(*out))


def links(prints: DataFrame, col: str, budget: int, leaf_rows: int = 200_000, least_leaves: int = 64) -> DataFrame:
    """Edges (u, v long) that connect the distinct fingerprints of ``prints`` as all links within ``budget`` bits do."""
    spark = prints.sparkSession
    head = F.shiftrightunsigned(F.col(col), 64 - PREFIX).cast("int").alias("p")
    counts = {r.p: r.n for r in prints.groupBy(head).agg(F.count("*").alias("n")).collect()}  # at most 2^16 rows
    total = sum(counts.values())
    leaf_of = leaves(counts, max(1, min(leaf_rows, -(-total // least_leaves))))
    at_home: dict[int, int] = {}
    for p, n in counts.items():
        at_home[int(leaf_of[p])] = at_home.get(int(leaf_of[p]), 0) + n
    flips = np.array([0, *(sum(1 << b for b in c) for k in range(1, budget + 1) for c in combinations(range(PREFIX), k))], dtype=np.int64)
    table = spark.sparkContext.broadcast((leaf_of, _split(at_home, leaf_rows)))  # 2^16 numbers, and a prefix that is crowded by itself

    def deal(frames):
        leaf, parts = table.value
        for f in frames:
            x = f[col].to_numpy(np.int64)
            p = (x.view(np.uint64) >> np.uint64(64 - PREFIX)).astype(np.int64)
            for k in range(0, len(x), 20_000):
                near = np.sort(leaf[p[k : k + 20_000, None] ^ flips], axis=1)
                first = np.ones(near.shape, dtype=bool)
                first[:, 1:] = near[:, 1:] != near[:, :-1]
                home = leaf[p[k : k + 20_000]]
                first &= near <= home[:, None]
                row, at = np.nonzero(first)
                to, mine = near[row, at].astype(np.int64), near[row, at] == home[row]
                one, group, pair = _spread(to, x[k + row], parts)
                yield pd.DataFrame({"leaf": group, "pair": pair, "x": x[k + row][one], "home": mine[one]})

    def join(f):
        x, home = f["x"].to_numpy(np.int64).view(np.uint64), f["home"].to_numpy(bool)
        u, v = forest(np.sort(x[home]), np.sort(x[~home]), budget)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = prints.select(col).mapInPandas(deal, "leaf long, pair long, x long, home boolean")
    return dealt.groupBy("leaf", "pair").applyInPandas(join, "u long, v long")


#: Microseconds, about: a copy of a row that is dealt out, a node pair that is visited, a pair of rows whose signatures are compared.
_COPY, _VISIT, _COMPARE = 10.0, 0.1, 0.05


def _within(p: float, bits: int, budget: int) -> float:
    """Chance that at most ``budget`` of ``bits`` bits differ, each with chance p."""
    return sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(budget + 1))


def tables_for(n: int, p: float, miss: float, signature: int) -> tuple[int, int, int]:
    """(tables, budget, width) for n rows: of the settings that overlook pairs whose bits differ with chance p no oftener than ``miss``, the cheapest.

    A fingerprint of (budget + 1) * width bits is cut into budget + 1 blocks, of
    which one is equal in every pair within the budget. With more rows the
    blocks get wider, so groups do not grow with the corpus; the number of
    tables grows instead.
    """
    best = None
    for budget in range(1, 5):
        for width in range(3, min(30, 62 // (budget + 1), signature // (budget + 1)) + 1):
            bits = (budget + 1) * width
            tables = max(1, math.ceil(math.log(miss) / math.log1p(-min(_within(p, bits, budget), 1 - 1e-9))))
            rows = n / 2**width
            visits = sum(math.comb(int(math.log2(rows + 2)), k) for k in range(budget + 1))
            cost = tables * (budget + 1) * (_COPY + _VISIT * visits + _COMPARE * rows / 2 * _within(0.5, bits - width, budget))
            best = min(best or (math.inf,), (cost, tables, budget, width))
    return best[1:]


def similar(rows: DataFrame, id_col: str, words: list[str], *, p: float, miss: float, check: int, within: int, group_rows: int = 200_000) -> DataFrame:
    """Edges (u, v long) between ids of ``rows`` whose long signatures (``words``, 64 bits each) are alike.

    Each table takes a fingerprint from the signature, bits drawn by a fixed
    seed, and joins it within a budget (:func:`tables_for`). Of the blocks of a
    fingerprint one is equal in every such pair, so a row goes to one group for
    each block, and the trie there starts below the block's value. Pairs that
    the trie finds are links if the first ``check`` words differ in at most
    ``within`` bits. A task returns a spanning forest of its links. Groups over
    ``group_rows`` rows (near copies of one text share their blocks) are cut
    into parts, with a task for each two parts.
    """
    n, signature = rows.count(), 64 * len(words)
    tables, budget, width = tables_for(max(n, 2), p, miss, signature)
    bits = (budget + 1) * width
    rng, pool, places = np.random.default_rng(6), np.zeros(0, dtype=np.int64), []
    for _ in range(tables):  # bits are used again only when all have been
        pool = pool if len(pool) >= bits else rng.permutation(signature)
        places.append(pool[:bits])
        pool = pool[bits:]

    def keys(f):
        """(block number, key) of every row: the block first, then the other bits."""
        w = np.stack([f[c].to_numpy(np.int64).view(np.uint64) for c in words], axis=1)
        on = np.unpackbits(np.ascontiguousarray(w).view(np.uint8), axis=1, bitorder="little")
        for t, at in enumerate(places):
            own = np.zeros((len(on), 64), dtype=np.uint8)
            own[:, :bits] = on[:, at]
            for b in range(budget + 1):
                turned = np.zeros_like(own)
                turned[:, :bits] = np.roll(own[:, :bits], -b * width, axis=1)
                key = np.packbits(turned, axis=1).view(">u8").reshape(-1).astype(np.uint64)
                yield t * (budget + 1) + b, key

    def group_of(number, key):
        return (np.int64(number) << np.int64(width)) + (key >> np.uint64(64 - width)).astype(np.int64)

    def tally(frames):
        for f in frames:
            for k in range(0, len(f), 50_000):
                for number, key in keys(f.iloc[k : k + 50_000]):
                    g, c = np.unique(group_of(number, key), return_counts=True)
                    yield pd.DataFrame({"g": g, "n": c})

    hot = {}
    if n > group_rows:
        big = rows.select(*words).mapInPandas(tally, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") > group_rows)
        hot = _split({r.g: r.n for r in big.collect()}, group_rows)  # no more than tables * blocks * n / group_rows rows
    table = rows.sparkSession.sparkContext.broadcast(hot)

    def deal(frames):
        parts = table.value
        for f in frames:
            ids = f[id_col].to_numpy(np.int64)
            own = {f"w{k}": f[words[k]].to_numpy(np.int64) for k in range(check)}
            for number, key in keys(f):
                one, group, pair = _spread(group_of(number, key), ids, parts)
                yield pd.DataFrame({"g": group, "pair": pair, "key": key.view(np.int64)[one], "id": ids[one], **{c: v[one] for c, v in own.items()}})

    def join(f):
        key = f["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(key, kind="stable")
        key, ids = key[order], f["id"].to_numpy(np.int64)[order]
        sig = [f[f"w{k}"].to_numpy(np.int64).view(np.uint64)[order] for k in range(check)]
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty_like(by_id)
        rank[by_id] = np.arange(len(ids))
        labels = Labels(len(ids))
        for i, j in close_pairs(key, None, budget, bits, width):
            near = sum(np.bitwise_count(s[i] ^ s[j]).astype(np.int32) for s in sig) <= within
            if near.any():
                labels.add(rank[i[near]], rank[j[near]])
        of = labels.settle()
        moved = np.nonzero(of != np.arange(len(ids)))[0]
        ids = ids[by_id]
        return pd.DataFrame({"u": ids[moved], "v": ids[of[moved]]})

    schema = "g long, pair long, key long, id long, " + ", ".join(f"w{k} long" for k in range(check))
    return rows.select(id_col, *words).mapInPandas(deal, schema).groupBy("g", "pair").applyInPandas(join, "u long, v long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(v, root) for every vertex of ``edges`` (u, v long); root is the smallest vertex of its component.

    Alternating large-star and small-star steps, each an aggregation of minima
    and a join, so that a hub with many edges is pre-aggregated and its join can
    be split. Every step is written to the shared folder.
    """
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
        edges = materialise(small, label)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("v"), "root")
    return roots.unionByName(edges.select("v", F.col("v").alias("root")).distinct())
