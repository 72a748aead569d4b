import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import simhash, trie


def brute_print(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(items, bits=2):
    """{position: smallest id} by union of all pairs; None counts as the largest."""
    big = 1 << 63
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if bin(items[a][1] ^ items[b][1]).count("1") <= bits:
                parent[find(a)] = find(b)
    out = {}
    for k, (i, _) in enumerate(items):
        out.setdefault(find(k), []).append(big if i is None else i)
    return [None if (m := min(out[find(k)])) == big else m for k in range(len(items))]


def texts():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    near = [t.rsplit(" ", 1)[0] for t in base]
    return base + near + base[:20] + [None, "", " \n", "One two", "ONE  two", "é É", "x" * 100_000, " ".join(words * 2000)]


def test_fingerprints_and_groups(spark, make_docs, tables):
    all_ = texts()
    got = {r.doc_id: r for r in simhash.op6_simhash(spark, tables(documents=make_docs(all_))).collect()}
    prints = [brute_print(t) for t in all_]
    assert [got[k].fingerprint for k in range(len(all_))] == [f"{p:016x}" for p in prints]
    assert [got[k].component_id for k in range(len(all_))] == brute_groups(list(enumerate(prints)))


def test_chains_of_links(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(300):  # long chains, each step two bits
        p = rng.choice(prints[-60:])
        prints.append(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints += [0, 1, 3, (1 << 64) - 1, (1 << 64) - 2] + prints[:30]
    ids = [rng.randrange(1000) if k % 17 else None for k in range(len(prints))]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p, k) for k, (i, p) in enumerate(zip(ids, signed))], "doc_id long, fp long, k int")
    for leaf_rows in (200_000, 7):
        got = {r.k: r.component_id for r in simhash.groups(df, leaf_rows=leaf_rows).collect()}
        assert [got[k] for k in range(len(prints))] == brute_groups(list(zip(ids, prints)))


def test_trie_finds_all_pairs():
    rng = np.random.default_rng(3)
    x = np.unique(np.concatenate([rng.integers(0, 1 << 63, 800, dtype=np.uint64), rng.integers(0, 1 << 9, 200, dtype=np.uint64)]))
    for budget in (0, 1, 2, 4):
        pairs = set()
        for i, j in trie.close_pairs(x, None, budget):
            pairs |= set(zip(i.tolist(), j.tolist()))
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= budget
        assert pairs == {(a, b) for a, b in zip(*np.nonzero(near)) if a < b}
    y = np.sort(rng.integers(0, 1 << 12, 600, dtype=np.uint64) << np.uint64(52))  # equal values too
    pairs = [p for i, j in trie.close_pairs(y, None, 3, 12, 4) for p in zip(i.tolist(), j.tolist())]
    near = (np.bitwise_count(y[:, None] ^ y[None, :]) <= 3) & (y[:, None] >> np.uint64(60) == y[None, :] >> np.uint64(60))
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a, b in zip(*np.nonzero(near)) if a < b}


def _corpus(seed=5):
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(5000)]
    base = [[rng.choice(words) for _ in range(rng.randint(150, 400))] for _ in range(120)]
    near = []
    for w in base:
        w = list(w)
        for _ in range(max(1, len(w) // 100)):  # each changed word changes five shingles of the union: similarity over 0.9
            w[rng.randrange(len(w))] = "changed"
        near.append(w)
    half = [w[: len(w) // 2] + [rng.choice(words) for _ in range(len(w) // 2)] for w in base]  # similarity a third
    return [" ".join(w) for w in base + near + half + base[:10]]


def test_near_copies_go_and_others_stay(spark, make_docs):
    docs = make_docs(_corpus())
    out = simhash.keep_one(docs)
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns
    assert set(range(120)) <= kept and set(range(240, 360)) <= kept
    assert len(kept & set(range(120, 240))) <= 6 and not kept & set(range(360, 370))


def test_repeated_rows_nulls_and_empty_tables(spark, make_docs):
    docs = make_docs(["same words in this text here"] * 4 + [None, "", "another text of its own words"], ids=[5, 5, 3, None, 8, 7, None])
    got = sorted((r.doc_id is None, r.doc_id, r.text) for r in simhash.keep_one(docs).collect())
    assert got == [(False, 3, "same words in this text here"), (False, 7, ""), (True, None, "another text of its own words")]
    assert simhash.keep_one(docs.limit(0)).count() == 0 and simhash.near_duplicates(docs.limit(0)).count() == 0
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.keep_one(nulls).count() == 3
    assert {r.component_id for r in simhash.near_duplicates(nulls).collect()} == {None}


def _shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def test_links_are_exact(spark, make_docs):
    rng = random.Random(11)
    word = lambda: f"u{rng.randrange(10**6)}"
    base = [[word() for _ in range(200)] for _ in range(60)]
    changed = {n: [w[:-n] + [word() for _ in range(n)] for w in base] for n in (21, 22, 28, 35)}  # similarity 0.806, 0.798, 0.75, 0.70
    texts = [" ".join(w) for ws in [base, *changed.values()] for w in ws]
    sets = [_shingles(t) for t in texts]
    gone = set()
    for k in range(60):  # the members of a family meet nobody else
        family = range(k, len(texts), 60)
        near = {(a, b) for a in family for b in family if a < b and _jaccard(sets[a], sets[b]) >= 0.8}
        assert near == {(k, 60 + k)}
        gone |= {b for _, b in near}
    kept = {r.doc_id for r in simhash.keep_one(make_docs(texts)).collect()}
    assert kept == set(range(len(texts))) - gone


def test_alike_matches_all_pairs():
    rng = np.random.default_rng(12)
    sets = [np.zeros(0, dtype=np.uint64)]
    for _ in range(25):  # chains: each set is a small change of an earlier one
        s = set(rng.integers(0, 1 << 60, 30).tolist())
        for _ in range(int(rng.integers(1, 9))):
            sets.append(np.array(sorted(s), dtype=np.uint64))
            for x in rng.choice(sorted(s), int(rng.integers(1, 6)), replace=False).tolist():
                s.remove(x)
                s.add(int(rng.integers(0, 1 << 60)))
    sets = [sets[k] for k in rng.permutation(len(sets))]
    want = list(range(len(sets)))
    plain = [set(s.tolist()) for s in sets]
    for _ in sets:  # minima spread until nothing moves
        for a in range(len(sets)):
            for b in range(a):
                if plain[a] and plain[b] and _jaccard(plain[a], plain[b]) >= 0.8:
                    want[a] = want[b] = min(want[a], want[b])
    assert simhash.alike(sets, 0.8).tolist() == want and len(set(want)) > 30
    assert simhash.alike([], 0.8).tolist() == []


def test_large_groups_are_compared_in_parts(spark, make_docs):
    rng = random.Random(14)
    word = lambda: f"x{rng.randrange(10**6)}"
    base = [word() for _ in range(300)]
    copies = []
    for _ in range(60):  # a chain: each text is a small change of the one before it
        base = list(base)
        for _ in range(3):
            base[rng.randrange(300)] = word()
        copies.append(" ".join(base))
    texts = copies + [" ".join(word() for _ in range(300)) for _ in range(20)]
    sets = [_shingles(t) for t in texts]
    root = list(range(len(texts)))
    for _ in root:
        for a in range(len(texts)):
            for b in range(a):
                if _jaccard(sets[a], sets[b]) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
    want = {k for k in range(len(texts)) if root[k] == k}
    for meet in (20_000, 7):
        assert {r.doc_id for r in simhash.keep_one(make_docs(texts), meet=meet).collect()} == want
    words = ["a", "b", "c"]
    rows = simhash.signatures(make_docs(texts).select("doc_id", "text"), "text", words).drop("text")
    found = []
    for most in (200_000, 9):
        edges = trie.similar(rows, "doc_id", words, p=simhash.differing_share(0.8), miss=0.001, check=3, within=60, group_rows=most)
        found.append({r.v: r.root for r in trie.components(edges, "t").collect()})
    assert found[0] == found[1] and len(set(found[0].values())) >= 1


def test_tables_follow_the_rows():
    p = simhash.differing_share(0.8)
    for n in (2, 1_000, 10**5, 10**7, 10**9):
        tables, budget, width = trie.tables_for(n, p, 0.001, 384)
        found = trie._within(p, (budget + 1) * width, budget)
        assert (1 - found) ** tables <= 0.001 and (budget + 1) * width <= 62
        assert n / 2**width <= 2e5  # groups do not grow with the corpus


def test_crowded_prefixes_are_cut_into_parts(spark):
    rng = random.Random(15)
    prints = sorted({rng.getrandbits(10) for _ in range(300)} | {1 << 63 | rng.getrandbits(8) for _ in range(100)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(signed)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.groups(df, bits=1, leaf_rows=13).collect()}
    assert [got[k] for k in range(len(prints))] == brute_groups(list(enumerate(prints)), 1)


def test_clashing_columns(spark, make_docs):
    docs = make_docs(["some words of a text", "some words of a text", "others"]).withColumns({"_row": F.lit(1), "_w0": F.lit("x"), "v": F.lit(2), "root": F.lit(3), "fingerprint": F.lit(4), "component_id": F.lit(5), "_text": F.lit(6)})
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 2]
    assert simhash.near_duplicates(docs).columns == ["doc_id", "fingerprint", "component_id"]
